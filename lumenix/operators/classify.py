"""Classifiers: window text to descriptors, per dimension. Model-written descriptors go through an injected client."""

from __future__ import annotations

import heapq
import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenix.functions import declaration as decl
from lumenix.functions import text as tx
from lumenix.operators.score import term_records

WHOLE_NAME = 3


def declaration_terms(segments: DataFrame) -> DataFrame:
    """Term records of declared names: a whole name counts three times per declaration, a distinct part of one once
    per window. Windows that declare nothing have no slot."""
    named = segments.withColumn("names", decl.declared_names(F.col("text"))).where(F.size("names") > 0)
    whole = F.flatten(F.transform("names", lambda n: F.array_repeat(F.lower(n), WHOLE_NAME)))
    parts = F.array_distinct(F.flatten(F.transform("names", lambda n: F.filter(tx.terms(n), lambda t: t != F.lower(n)))))
    return term_records(named.withColumn("terms", F.concat(whole, parts)).withColumn("level", F.lit(0)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as an argument of a lambda, not copied into its body."""
    return F.element_at(F.transform(F.array(value), use), 1)


def frequency_descriptor(terms: Column) -> Column:
    """The stored form of an array of terms: sorted, then counted by where runs begin, so linear after the sort. Over whole
    tables, ``text.described`` is faster."""

    def of(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))

        def spelled(runs: Column) -> Column:
            n = lambda i, k: F.coalesce(F.get(runs, k + 1), F.size(s)) - i
            one = lambda i, k: F.concat(F.get(s, i), F.when(n(i, k) > 1, F.concat(F.lit(":"), n(i, k).cast("string"))).otherwise(F.lit("")))
            return F.array_join(F.transform(runs, one), " ")

        return _let(first, spelled)

    return F.when(F.size(terms) > 0, _let(F.sort_array(terms), of)).when(terms.isNotNull(), F.lit(""))


def content_descriptor(sources: Column) -> Column:
    """Sources behind each other; null if that is empty."""
    joined = F.array_join(sources, "\n\n")
    return F.when(joined != "", joined)


def group_by_implementation(dimensions: Mapping[str, str]) -> dict[str, list[str]]:
    """Dimensions that share an implementation are answered by one call."""
    out: dict[str, list[str]] = {}
    for name in sorted(dimensions):
        out.setdefault(dimensions[name], []).append(name)
    return dict(sorted(out.items()))


# -- model-written descriptors

ITEM_BYTES, BATCH_CHARS, BATCH_ITEMS = 5_000, 24_000, 60
DEFAULT_PROMPTS = {0: "Describe what each numbered text does and says, for a search index.", 1: "Name what the numbered groups of descriptions have in common, for a search index."}


class ChatClient(Protocol):
    def __call__(self, system: str, user: str, schema: dict) -> str: ...


class TransportError(Exception):
    """The endpoint or the network failed: a smaller batch cannot help."""


class ReplyError(Exception):
    """The model answered with something unusable."""


@dataclass(frozen=True)
class Part:
    """A named part of an answer: text, or a list of short strings with an optional cap."""

    name: str
    is_list: bool = False
    cap: int | None = None

    @classmethod
    def parse(cls, spec: str) -> "Part":
        m = re.fullmatch(r"([^\[]*)(?:\[(.*))?", spec, re.S)
        if m[2] is None:
            return cls(m[1])
        number = m[2].rstrip("]")
        return cls(m[1], True, int(number) if number.isdigit() and int(number) > 0 else None)

    def spelled(self) -> str:
        return f"{self.name}[{self.cap or ''}]" if self.is_list else self.name

    def schema(self) -> dict:
        if not self.is_list:
            return {"type": "string"}
        return dict(type="array", items=dict(type="string")) | ({"maxItems": self.cap} if self.cap else {})

    def said(self) -> str:
        return self.name + (f" (short strings, the most important first{f', {self.cap} at most' if self.cap else ''})" if self.is_list else "")


@dataclass(frozen=True)
class Facets:
    """The enforced shape of an answer; without parts, plain prose."""

    parts: tuple[Part, ...] = ()

    @classmethod
    def parse(cls, specs: Sequence[str]) -> "Facets":
        return cls(tuple(map(Part.parse, specs)))

    def schema(self) -> dict:
        if not self.parts:
            return {"type": "string"}
        return {"type": "object", "properties": {p.name: p.schema() for p in self.parts}, "required": [p.name for p in self.parts], "additionalProperties": False}

    def compose(self, value: Any) -> str:
        """One descriptor: lists as bare tokens up to their cap, texts trimmed, in order of the parts."""
        if not self.parts:
            return value.strip() if isinstance(value, str) else ""
        out = []
        for p in self.parts:
            v = value.get(p.name) if isinstance(value, dict) else None
            if p.is_list:
                out.append(" ".join([x for x in v if isinstance(x, str)][: p.cap]) if isinstance(v, list) else "")
            else:
                out.append(v.strip() if isinstance(v, str) else "")
        return " ".join(x for x in out if x)

    def identity(self) -> str:
        return ",".join(p.spelled() for p in self.parts) or "prose"


def reply_schema(dimensions: Sequence[str], facets: Facets) -> dict:
    item = {"type": "object", "properties": {d: facets.schema() for d in dimensions}, "required": list(dimensions), "additionalProperties": False}
    return dict(type="object", properties=dict(segments=dict(type="array", items=item)), required=["segments"], additionalProperties=False)


def messages(prompt: str, dimensions: Sequence[str], items: Sequence[str], level: int, facets: Facets) -> tuple[str, str]:
    noun = "Segment" if level == 0 else "Group"
    shape = f" Give for each: {', '.join(p.said() for p in facets.parts)}." if facets.parts else ""
    system = f"{prompt} Answer for the facets {', '.join(dimensions)}, with one entry in `segments` for each of the {len(items)} items, in their order.{shape}"
    return system, "\n\n".join(f"--- {noun} {i} ---\n{text}" for i, text in enumerate(items, 1))


def for_level(prompts: Mapping[int, str], level: int) -> str:
    """The prompt of a level: its own, else that of the nearest level below, else the default."""
    below = [k for k in prompts if k <= level]
    return prompts[max(below)] if below else DEFAULT_PROMPTS[min(level, 1)]


def chunk_ranges(lengths: Sequence[int], budget: int = BATCH_CHARS, most: int = BATCH_ITEMS) -> list[tuple[int, int]]:
    """Contiguous greedy chunks within a size and a count; an item over the budget is a chunk of its own."""
    out: list[tuple[int, int]] = []
    lo = used = 0
    for i, n in enumerate(lengths):
        if i > lo and (i - lo >= max(most, 1) or used + n > budget):
            out.append((lo, i))
            lo, used = i, 0
        used += n
    return [*out, (lo, len(lengths))] if lengths else out


def truncated(text: str, most: int = ITEM_BYTES) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def read_reply(reply: str, count: int) -> list[Any]:
    try:
        found = json.loads(reply)["segments"]
    except (ValueError, KeyError, TypeError) as e:
        raise ReplyError("the reply is not the JSON that was asked for") from e
    if not isinstance(found, list) or len(found) != count:
        raise ReplyError("the reply has another number of entries")
    return found


@dataclass
class ChatClassifier:
    """Descriptors by a chat model. A bad reply halves its batch; a single item that stays bad is left blank and counted."""

    client: ChatClient
    facets: Facets = Facets()
    prompts: Mapping[int, str] = field(default_factory=dict)
    blank: int = 0

    def _ask(self, items: Sequence[str], dimensions: Sequence[str], level: int) -> list[Any]:
        try:
            system, user = messages(for_level(self.prompts, level), dimensions, items, level, self.facets)
            return read_reply(self.client(system, user, reply_schema(dimensions, self.facets)), len(items))
        except ReplyError:
            if len(items) == 1:
                self.blank += 1
                return [{}]
            half = len(items) // 2
            return self._ask(items[:half], dimensions, level) + self._ask(items[half:], dimensions, level)

    def inspect(self, items: Sequence[Sequence[str]], dimensions: Sequence[str], level: int = 0) -> list[tuple[Any, dict[str, str]]]:
        """Per item the raw answer and what is stored of it (dimensions with an empty text are left out)."""
        texts = [truncated("\n\n".join(x)) for x in items]
        raw: list[Any] = []
        for lo, hi in chunk_ranges([len(t.encode()) for t in texts]):
            raw += self._ask(texts[lo:hi], dimensions, level)
        return [(r, {d: text for d in dimensions if isinstance(r, dict) and (text := self.facets.compose(r.get(d)))}) for r in raw]

    def __call__(self, items: Sequence[Sequence[str]], dimensions: Sequence[str], level: int = 0) -> list[dict[str, str]]:
        return [stored for _, stored in self.inspect(items, dimensions, level)]


def retrying(send: Callable[[str, str, dict], tuple[int, str, float | None]], tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> ChatClient:
    """A client over ``send`` -> (status, body, retry-after): repeats on 429, 5xx and broken connections.

    Waits what the server asks for (120 seconds at most), else 2^n seconds (60 at most).
    """

    def client(system: str, user: str, schema: dict) -> str:
        problem = ""
        for n in range(tries + 1):
            after = None
            try:
                status, body, after = send(system, user, schema)
                if status == 200:
                    return body
                problem = f"status {status}"
                if status != 429 and status < 500:
                    break
            except OSError as e:
                problem = str(e)
            if n < tries:
                sleep(min(after, 120.0) if after is not None else min(2.0**n, 60.0))
        raise TransportError(problem)

    return client


def stub_client(words: int = 6) -> ChatClient:
    """An offline stand-in: describes an item by its most frequent long words. Deterministic."""

    def client(system: str, user: str, schema: dict) -> str:
        items = re.split(r"(?:^|\n\n)--- (?:Segment|Group) \d+ ---\n", user)[1:]
        entries = schema["properties"]["segments"]
        shape = entries["items"]

        def ranked(text: str) -> list[str]:
            counts = Counter(re.findall(r"\w{4,}", text.lower()))
            return [w for w, _ in heapq.nsmallest(words, counts.items(), key=lambda x: (-x[1], x[0]))]

        def value(kind: dict, top: list[str]) -> Any:
            if kind["type"] == "string":
                return " ".join(top)
            if kind["type"] == "array":
                return top[: kind.get("maxItems")]
            return {k: value(v, top) for k, v in kind["properties"].items()}

        return json.dumps({"segments": [{d: value(s, top) for d, s in shape["properties"].items()} for top in map(ranked, items)]})

    return client


def describe(segments: DataFrame, dimensions: Sequence[str], make: Callable[[], ChatClassifier]) -> DataFrame:
    """origin, resource, start, end, level, dimension, descriptor for windows, in one pass over the files of a task.

    ``make`` builds the classifier in the worker, once a task, so that clients need not be sent. Requests hold windows of one
    file, so a file's chunks do not depend on its neighbours: rows are brought together by file and sorted by start, and a task
    holds one file's windows at a time.
    """
    import pyarrow as pa

    schema = "origin string, resource string, start bigint, end bigint, level int, dimension string, descriptor string"
    place = ["origin", "resource", "start", "end"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def files(batches: Iterator[Any]) -> Iterator[list]:
        now: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*place, "text"])):
                if now and row[:2] != now[0][:2]:
                    yield now
                    now = []
                now.append(row)
        if now:
            yield now

    def table(rows: list) -> Any:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*place, "level", "dimension", "descriptor"])

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        ask = make()
        out: list = []
        for rows in files(batches):
            found = ask([[r[4]] for r in rows], list(dimensions), 0)
            out += [(*r[:4], 0, d, text) for r, f in zip(rows, found) for d, text in f.items()]
            if len(out) >= 1000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    whole = segments.select(*[F.col(c).cast("bigint") if c in ("start", "end") else F.col(c) for c in place], "text")
    return whole.repartition("origin", "resource").sortWithinPartitions(*place).mapInArrow(run, schema)


def batches(rows: Iterator[Any], size: int) -> Iterator[list]:
    now: list = []
    for r in rows:
        now.append(r)
        if len(now) == size:
            yield now
            now = []
    if now:
        yield now
