"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut before single blanks between non-blank characters. The split pattern starts a new match
there in any case (no alternative reaches over such a blank, and the look-ahead only concerns runs of
white space), so the pieces can be encoded one by one and their ids joined. That bounds what the
library sees of a long text, and lets frequent pieces come from a bounded memo. Texts with other runs
of white space go through the library in cuts at the same kind of boundary, before any single white-space character.

The library's search overflows its stack on a run of about a million white-space characters. Such a run is one match by
the pattern, but for its last character if a non-blank follows: runs of ``RUN`` or more are cut out and encoded as the
one piece they are. All this holds for the pattern ``BYTE_LEVEL``; with any other, whole texts go to the library.

Edge cases: a null or empty text has no ids; any valid text survives the round trip, runs of millions of characters of
one kind and texts without a blank among them; ids never hold special tokens (their strings in a text are ordinary text);
repeated rows are encoded alike; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

MEMO_ENTRIES = 250_000
LONG = 1 << 16
RUN = 1 << 13
#: The split of byte-level tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the libraries take for white space; ``str.isspace`` has a few control characters more.
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SAFE = re.compile(rf"(?<=\S){WHITE}(?=\S)")
_RUNS: dict[int, re.Pattern] = {}
_LOADED: dict[tuple[str, str], tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def safe_cuts(text: str, size: int = LONG) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut only where the pattern starts a match anyway (longer if there is no such place)."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_split(enc: tiktoken.Encoding, text: str) -> list[int]:
    """``enc.encode_ordinary(text)`` for the pattern ``BYTE_LEVEL``, whatever the length of its runs of white space."""
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    if RUN not in _RUNS:
        _RUNS[RUN] = re.compile(WHITE + f"{{{RUN},}}")
    out: list[int] = []
    at = 0
    for m in _RUNS[RUN].finditer(text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class PieceEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, from ``encode``: ids of a list of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: int = MEMO_ENTRIES):
        self._encode, self._entries = encode, entries
        self._inner: dict[str, bytes] = {}
        self._missed = 0

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        return [_pack(ids) for ids in self._encode(pieces)]

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        if len(text) > LONG:
            return b"".join(self._whole(p) for p in safe_cuts(text))
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        words = text.split(" ")
        head = words[0]
        if not head and len(words) > 1:  # it begins with a blank, as pieces of long texts do
            words = words[1:]
            first = None
        else:
            first = head
        memo = self._inner
        rest = words if first is None else words[1:]
        found = list(map(memo.get, rest))
        if None in found:
            missing = list(dict.fromkeys(w for w, f in zip(rest, found) if f is None))
            if any(not w or w[0].isspace() or w[-1].isspace() for w in missing):
                return self._fresh([text])[0]
            new = dict(zip(missing, self._fresh([" " + w for w in missing])))
            if len(memo) < self._entries:
                memo.update((w, v) for w, v in new.items() if len(w) <= 64)
            else:  # full: frequent pieces are in; start anew only when the text has changed its vocabulary
                self._missed += len(missing)
                if self._missed > 8 * self._entries:
                    memo.clear()
                    self._missed = 0
            found = [new[w] if f is None else f for w, f in zip(rest, found)]
        if first is not None:
            if first and first[-1].isspace():
                return self._fresh([text])[0]
            found.insert(0, self._fresh([first])[0])
        return b"".join(found)


class LibraryEncoder:
    """Whole texts by the library, for patterns whose boundaries are not known here."""

    def __init__(self, enc: tiktoken.Encoding):
        self._enc = enc

    def packed(self, text: str) -> bytes:
        return _pack(self._enc.encode_ordinary(text))


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, PieceEncoder | LibraryEncoder]:
    """One encoder per worker process and rank file."""
    if (path, pattern) not in _LOADED:
        enc = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        if pattern == BYTE_LEVEL:
            _LOADED[path, pattern] = (enc, PieceEncoder(lambda pieces: [encode_split(enc, p) for p in pieces]))
        else:
            _LOADED[path, pattern] = (enc, LibraryEncoder(enc))
    return _LOADED[path, pattern]


def encode_column(path: str, pattern: str, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Per row: packed ids and the bytes decoded from them."""
    enc, pieces = encoder(path, pattern)
    for value in column:
        ids = pieces.packed(value.as_py() or "")
        yield ids, enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for ids, raw in encode_column(path, pattern, batch.column(1)):
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its ids as an array: the operator for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(encoder(path, pattern)[1].packed(v.as_py() or ""), "<u4").astype(np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of its ``ids``; bytes that are no valid UTF-8 stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [encoder(path, pattern)[0].decode_bytes(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, raw binary")
