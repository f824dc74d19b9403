"""Column functions over text: line ends, terms, frequency descriptors, spans, display."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are worked on at once.
SLICE = 512
WORD_RUN = r"[\p{IsAlphabetic}\p{N}_]+"


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF; nothing else changes."""
    return F.regexp_replace(text, "\r\n?", "\n")


#: An upper-case letter behind a lower-case one or a digit, ``_``, and the letters whose lower case depends on what is around
#: them, is not all letters, is a single byte or is known to one of folding and matching only.
UNEVEN = r"[_\p{IsUppercase}\ua7cb-\ua7dc](?<=[_\u0130\u03a3\u212a\ua7cb-\ua7dc]|[\p{IsLowercase}\p{N}].)"


def uneven(text: Column) -> Column:
    """Whether a run of ``text`` may have parts, or be folded otherwise on its own than within the text; so all texts with
    characters beyond the basic plane, which are two units each."""
    return text.rlike(UNEVEN) | (F.octet_length(F.encode(text, "UTF-16BE")) != 2 * F.length(text))


def terms(text: Column) -> Column:
    """Search terms in order: of every run of letters, digits and ``_`` first its parts (cut at ``_`` and where
    an upper-case letter follows a lower-case one or a digit), then the run itself, all in lower case. Runs and
    parts under two bytes are left out, and so is a last part that equals the run.

    Texts without anything to cut, nearly all, are folded whole and their runs taken out by one expression."""
    runs = lambda of: F.filter(F.regexp_extract_all(of, F.lit(WORD_RUN), F.lit(0)), lambda r: F.octet_length(r) >= 2)

    def of(run: Column) -> Column:
        cut = F.split(F.regexp_replace(run, r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})", "_"), "_")
        whole = F.lower(run)
        parts = F.transform(F.filter(cut, lambda p: F.octet_length(p) >= 2), lambda p: F.lower(p))
        # Most runs have one part only: skip the work there.
        plain = ~run.rlike(r"_|[\p{IsLowercase}\p{N}]\p{IsUppercase}")
        return F.when(plain, F.array(whole)).otherwise(F.concat(F.filter(parts, lambda p: p != whole), F.array(whole)))

    return F.when(uneven(text), F.flatten(F.transform(runs(text), of))).otherwise(runs(F.lower(text)))


def encode_frequencies(counts: Column) -> Column:
    """A map of term to count as ``term[:count]``, sorted, blank-separated; a count of one is not spelt out."""
    entries = F.sort_array(F.map_entries(counts))  # keys are unique, so values are not compared
    return F.array_join(F.transform(entries, lambda e: F.when(e["value"] == 1, e["key"]).otherwise(F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), " ")


def decode_frequencies(descriptor: Column) -> Column:
    """Structs (term, tf) of a frequency descriptor; a count that cannot be read is one."""
    words = F.filter(F.split(descriptor, r"\s+"), lambda w: w != "")
    read = lambda w: F.coalesce(F.regexp_extract(w, r"^[^:]*:(\d{1,10})$", 1).try_cast("bigint"), F.lit(1).cast("bigint"))
    # Most terms occur once and have no count to read.
    return F.transform(words, lambda w: F.when(w.contains(":"), F.struct(F.substring_index(w, ":", 1).alias("term"), read(w).alias("tf"))).otherwise(F.struct(w.alias("term"), F.lit(1).cast("bigint").alias("tf"))))


def _runs(terms):  # type: ignore[no-untyped-def]
    """(row, term, count) of an Arrow array of term arrays: per row its distinct terms in byte order, nulls left out."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(terms.flatten())
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row, code = np.repeat(np.arange(len(terms), dtype=np.int64), lengths), pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    key = np.sort(((row << 32) + rank[code])[code >= 0] if len(order) else np.zeros(0, np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = key[first]
    return own >> 32, coded.dictionary.take(pa.array(order[own & 0xFFFFFFFF])), np.diff(np.append(first, len(key)))


def counted(df: DataFrame, terms: str = "terms") -> DataFrame:
    """The other columns of ``df``, term, tf: a row for every distinct term of each row's array, without a shuffle."""
    kept = [c for c in df.columns if c != terms]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches):  # type: ignore[no-untyped-def]
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                row, term, n = _runs(batch.column(terms))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in kept], term, pa.array(n, pa.int64())], [*kept, "term", "tf"])

    return df.select(*kept, terms).mapInArrow(run, schema)


def described(df: DataFrame, terms: str, name: str) -> DataFrame:
    """The other columns of ``df`` and ``name``, the stored form of each row's array of terms: ``term[:count]``, sorted,
    blank-separated; nulls in an array do not count."""
    kept = [c for c in df.columns if c != terms]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.StringType())])

    def run(batches):  # type: ignore[no-untyped-def]
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                own = batch.column(terms)
                row, term, n = _runs(own)
                several = pc.binary_join_element_wise(term, pa.array(n).cast(pa.string()), ":")
                ends = np.searchsorted(row, np.arange(len(own) + 1))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.if_else(pa.array(n > 1), several, term)), " ")
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pc.if_else(own.is_valid(), text, pa.scalar(None, pa.string()))], [*kept, name])

    return df.select(*kept, terms).mapInArrow(run, schema)


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets, moved down to character boundaries; inverted spans are empty."""
    raw = F.encode(text, "UTF-8")
    n = F.length(raw)

    def snap(at: Column) -> Column:
        at = F.least(F.greatest(at, F.lit(0)), n)
        # A byte 10xxxxxx is inside a character: step back up to three.
        inside = lambda k: (at - k < n) & (at - k >= 0) & F.hex(F.substring(raw, (at - k + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
        return F.when(~inside(0), at).when(~inside(1), at - 1).when(~inside(2), at - 2).otherwise(at - 3)

    lo, hi = snap(start), snap(end)
    return F.when(lo < hi, F.decode(F.substring(raw, (lo + 1).cast("int"), (hi - lo).cast("int")), "UTF-8")).otherwise(F.lit(""))


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line that holds a byte offset."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int"))
    feeds = F.octet_length(head) - F.octet_length(F.replace(F.decode(head, "UTF-8"), F.lit("\n"), F.lit("")).cast("binary"))
    return (1 + feeds).cast("int")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    cut = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def snippet(text: Column, first_line: Column, last_line: Column, shown: int = 12) -> Column:
    """The first ``shown`` lines of a hit's text, and notices of what is cut before and after."""
    rows = lines(text)
    n = F.size(rows)
    head = F.when(first_line > 1, F.concat(F.lit("[TRUNCATED "), (first_line - 1).cast("string"), F.lit(" lines before]\n"))).otherwise(F.lit(""))
    tail = F.when(n > shown, F.concat(F.lit("\n[TRUNCATED "), (n - shown).cast("string"), F.lit(" lines after]"))).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.slice(rows, 1, shown), "\n"), tail)


def terminal_safe(text: Column) -> Column:
    """Control characters shown as their escapes."""
    out = text
    for raw, shown in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\x1b", r"\\u{1b}")):
        out = F.regexp_replace(out, raw, shown)
    return F.regexp_replace(out, r"\p{Cc}", r"\\u{fffd}")


def quoted(text: Column, limit: int = 240) -> Column:
    """One line for a prompt or a report: blanks flattened, invisible and direction marks dropped, cut at ``limit``."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[​-‏‪-‮⁠-⁤⁦-⁩﻿]", ""), r"[\s\p{Cc}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def safe_key(key: Column) -> Column:
    """Whether a resource key is relative, tidy and portable."""
    parts = F.split(key, "/")
    bad = (
        (key == "")
        | key.startswith("/")
        | key.contains("\\")
        | F.element_at(parts, 1).contains(":")
        | key.rlike(r"\p{Cc}")
        | F.exists(parts, lambda p: p.isin("", ".", ".."))
    )
    return F.coalesce(~bad, F.lit(False))


def content_or_null(raw: Column) -> Column:
    """Decoded, LF-normalized text of a file's bytes; null for binary (a NUL among the first 8,000 bytes) or invalid UTF-8."""
    binary = F.position(F.lit(b"\x00"), F.substring(raw, 1, 8000)) > 0
    return F.when(~binary & F.is_valid_utf8(raw.cast("string")), normalize_newlines(F.decode(raw, "UTF-8")))
