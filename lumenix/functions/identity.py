"""Input-addressed identities: domain-separated SHA-256 over length-prefixed parts, as columns."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("content", "object", "fingerprint", "cluster")


def digest(domain: str, payload: Column) -> Column:
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}")
    return F.sha2(F.concat(F.lit(f"lumenix/1/{domain}:".encode()), payload.cast("binary")), 256)


def framed(*parts: Column) -> Column:
    """Parts behind their count and each behind its length, so that no two lists frame alike."""
    out = [F.lit(f"{len(parts)};")]
    for p in parts:
        text = F.coalesce(p.cast("string"), F.lit(""))
        out += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.concat(*out)


def object_key(fingerprint: Column | str, *inputs: Column) -> Column:
    fp = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return digest("object", framed(fp, *inputs))


def content_hash(payload: Column) -> Column:
    return digest("content", payload)


def cluster_key(fingerprint: str, children: Column) -> Column:
    """Order of the children does not matter."""
    return digest("cluster", framed(F.lit(fingerprint), F.size(children), F.array_join(F.array_sort(children), ",")))


def cluster_key_of(fingerprint: str, children: list[str]) -> str:
    joined = ",".join(sorted(children))
    parts = [fingerprint, str(len(children)), joined]
    text = f"{len(parts)};" + "".join(f"{len(p.encode())}:{p}" for p in parts)
    return hashlib.sha256(b"lumenix/1/cluster:" + text.encode()).hexdigest()


def fingerprint(value: Any) -> str:
    """Of a JSON-like value in canonical form: sorted keys, no white space."""
    return hashlib.sha256(b"lumenix/1/fingerprint:" + json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def canonical_json(*columns: Column) -> Column:
    """A struct as JSON without white space, fields in the given order; sort maps before."""
    return F.to_json(F.struct(*columns))
