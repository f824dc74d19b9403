"""Sequence packing: bounded-space online best fit, then a merge of what each partition left open.

Each partition keeps ``open_windows`` windows. A piece goes where it leaves the least room; a window that
becomes full leaves at once. When nothing fits and no window may be opened, the fullest is topped up with
the head of the piece and emitted (documents may be cut freely), so that no padding arises on the way.
Windows still open at a partition's end are written with their ids, a bounded number per partition; groups
of ``merge_partitions`` such partitions are packed once more, and what then remains is cut into full
sequences and a last one, which is split at powers of two (lengths that need no padding).

Edge cases: a null or empty text is its end mark alone, one token; repeated rows are packed once per row;
an empty table gives an empty result; a null id is packed like any other; texts of any length, runs of millions of
characters of one kind among them, are encoded whole; only ``doc_id`` and ``text`` are read, so other columns may have any
name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenix.llm import common
from lumenix.llm.bpe import BYTE_LEVEL, PieceEncoder, encode_split


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    open_windows: int = 32
    merge_partitions: int = 64
    end_id: int = 0


Piece = tuple[object, int, bytes, int]  # id, start, packed ids, tokens of the document
_LOADED: dict = {}


def as_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks a tokenizer file amounts to, or None if it does anything besides plain byte-level merges in id order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), *(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if model.get("type") != "BPE" or any(odd) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    merged = [(a + b if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"] for a, b in [m if isinstance(m, list) else ("", "")]]
    if len(vocab) != 256 + len(merged) or any(vocab[t] != 256 + k for k, t in enumerate(merged)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


class AddedTokens:
    """Cuts texts at a tokenizer file's added tokens, which stand for their ids; what lies between goes to ``inner``."""

    def __init__(self, ids: dict[str, int], inner: PieceEncoder):
        self.ids, self.inner = {t: i.to_bytes(4, "little") for t, i in ids.items()}, inner
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")

    def packed(self, text: str) -> bytes:
        return b"".join(self.ids[t] if k % 2 else self.inner.packed(t) for k, t in enumerate(self.cut.split(text)) if t)


class WholeTexts:
    """The library as it is, for files whose added tokens take blanks or word edges into account."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)

    def packed(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)


def encoder(path: str) -> PieceEncoder | AddedTokens | WholeTexts:
    """One tokenizer per worker process and file, with the ids of ``Tokenizer.encode`` without special tokens around.

    A file that is plain byte-level merges in id order is run by the faster of the two libraries, whose ids are the same;
    any other is run by ``tokenizers``. Added tokens in a text stand for their ids.
    """
    if path not in _LOADED:
        if ranks := as_ranks(path):
            fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            inner = PieceEncoder(lambda pieces: [encode_split(fast, p) for p in pieces])
        else:
            inner = library_encoder(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            _LOADED[path] = WholeTexts(path)
        else:
            _LOADED[path] = AddedTokens({t["content"]: t["id"] for t in added}, inner) if added else inner
    return _LOADED[path]


def library_encoder(path: str) -> PieceEncoder:
    """By ``tokenizers``; added tokens in a text are ordinary text here, ``encoder`` cuts them out before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return PieceEncoder(lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)])


class Packer:
    """Open windows of one partition; ``emit`` gets the pieces of each finished sequence in order."""

    def __init__(self, params: PackParams, emit: Callable[[list[Piece]], None]):
        self.p, self.emit = params, emit
        self.room: list[int] = []
        self.held: list[list[Piece]] = []

    def _close(self, k: int) -> None:
        self.emit(self.held.pop(k))
        self.room.pop(k)

    def add(self, piece: Piece) -> None:
        key, start, ids, total = piece
        cap = self.p.capacity
        n, at = len(ids) // 4, 0
        while n - at >= cap:
            self.emit([(key, start + at, ids[4 * at : 4 * (at + cap)], total)])
            at += cap
        while n > at:
            need = n - at
            best = min((k for k in range(len(self.room)) if self.room[k] >= need), key=self.room.__getitem__, default=None)
            if best is None and len(self.room) < self.p.open_windows:
                self.room.append(cap)
                self.held.append([])
                best = len(self.room) - 1
            if best is None:
                best = min(range(len(self.room)), key=self.room.__getitem__)
            take = min(need, self.room[best])
            self.held[best].append((key, start + at, ids[4 * at : 4 * (at + take)], total))
            self.room[best] -= take
            at += take
            if not self.room[best]:
                self._close(best)

    def finish(self) -> None:
        """Cut what is open into full sequences; the rest, under one capacity, at powers of two."""
        cap = self.p.capacity
        rest = [p for k in sorted(range(len(self.room)), key=lambda k: (self.room[k], k)) for p in self.held[k]]
        left = sum(len(p[2]) // 4 for p in rest)
        self.room, self.held = [], []
        size, now, used = 0, [], 0
        for key, start, ids, total in rest:
            n, at = len(ids) // 4, 0
            while at < n:
                if not size:
                    size = cap if left >= cap else 1 << (left.bit_length() - 1)
                take = min(n - at, size - used)
                now.append((key, start + at, ids[4 * at : 4 * (at + take)], total))
                used, at, left = used + take, at + take, left - take
                if used == size:
                    self.emit(now)
                    size, now, used = 0, [], 0


class _Rows:
    """Collects output rows and hands them on in batches."""

    def __init__(self, schema: pa.Schema, base: int):
        self.schema, self.next = schema, base
        self.cols: list[list] = [[] for _ in schema]

    def sequence(self, pieces: list[Piece]) -> None:
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.row(key, start, n, zlib.crc32(ids), total, self.next, at)
            at += n
        self.next += 1

    def row(self, *values: object) -> None:
        for c, v in zip(self.cols, values):
            c.append(v)
        for c in self.cols[len(values) :]:
            c.append(None)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return out


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _schema(key: pa.DataType, more: list[pa.Field]) -> pa.Schema:
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([pa.field("doc_id", key), *(pa.field(n, pa.int64()) for n in names), *more])


def pack(documents: DataFrame, tokenizer_path: str, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are read and encoded once, in a narrow pass whose pieces (and the bounded open windows) are
    written to the shared folder; only the open windows are shuffled.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    end = params.end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), None
        packer = None
        for batch in batches:
            if rows is None:
                rows = _Rows(_schema(batch.schema.field(0).type, [pa.field("part", pa.int32()), pa.field("ids", pa.binary())]), part << 32)
                packer = Packer(params, rows.sequence)
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encoder(tokenizer_path).packed(text.as_py() or "") + end
                packer.add((key.as_py(), 0, ids, len(ids) // 4))
                if len(rows.cols[0]) >= 20_000:
                    yield rows.batch()
        if rows is not None:
            for k, pieces in enumerate(packer.held):
                for key, start, ids, total in pieces:
                    rows.row(key, start, len(ids) // 4, 0, total, None, k, part, ids)
            yield rows.batch()

    pieces = common.materialize(documents.select("doc_id", "text").mapInArrow(first, f"doc_id {kind}, {_COLUMNS}, part int, ids binary"), "pieces")
    parts = pieces.where(F.col("sequence_id").isNull()).agg(F.max("part")).first()[0]
    done = pieces.where(F.col("sequence_id").isNotNull()).drop("part", "ids")
    if parts is None:
        return done

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = packer = group = None
        for batch in batches:
            for key, start, total, g, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "start", "doc_tokens", "grp", "ids"))):
                if g != group:
                    if packer is not None:
                        packer.finish()
                    if rows is None:
                        rows = _Rows(_schema(batch.schema.field(batch.schema.get_field_index("doc_id")).type, []), 0)
                    rows.next, group = (1 << 61) + (g << 32), g
                    packer = Packer(params, rows.sequence)
                packer.add((key, start, ids, total))
            if rows is not None and len(rows.cols[0]) >= 20_000:
                yield rows.batch()
        if rows is not None:
            packer.finish()
            yield rows.batch()

    groups = parts // params.merge_partitions + 1
    left = pieces.where(F.col("sequence_id").isNull()).withColumn("grp", (F.col("part") / params.merge_partitions).cast("int"))
    left = left.select("doc_id", "start", "doc_tokens", "grp", "part", "offset", "ids")
    merged = left.repartition(groups, "grp").sortWithinPartitions("grp", "part", "offset", "doc_id", "start").mapInArrow(merge, f"doc_id {kind}, {_COLUMNS}")
    return done.unionByName(merged)
