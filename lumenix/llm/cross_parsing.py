"""Ziv-Merhav cross-parsing: how well reference text predicts a document, as a relative entropy in bits a word.

A document is factored greedily into longest matches with its reference, found in a suffix automaton over the
reference's words; a word that does not occur there is a phrase by itself. With c phrases over n words and N words
of reference the cross term is c * log2(N + 2) / n; the self term is c' * log2(c') / n for the c' phrases of the
document's own incremental (Lempel-Ziv 1978) parse. The score is their difference: low for text like the reference.

Every document is parsed against the whole reference except its own text (an equal text with another id stays in).
Documents and reference are cut into units, and the longest match from each word position is found in rounds. In a round
every unit sends hashes of the grams it asks for, with their owners (id and text), to the task that has their part of all
hashes, and learns which of them another owner has on the other side. Positions of either side go on only with grams that
were found, so most words leave after two rounds. No unit meets another: work and traffic grow with documents and reference,
not with their product.

1. Grams of 1, then 2, then 3 and 4, then 5 to 8 words; a gram is asked only if all shorter ones asked inside it were found.
2. The powers of two from 16 words on, all in one round.
3. A match ends no earlier than that of the position before it. So ends of neighbours bound each other, and the first position
   of each stretch that is still open is searched between its power of two and the next, in steps of a sixteenth of the
   interval; then all positions that are open after that. A position of the reference takes part where a position with its
   gram searches.

Grams are compared by 64-bit hashes. Scores do not depend on how the reference or the documents are cut.

Edge cases: null, empty and blank texts have no words and score 0; without any reference the cross term takes every
word as a phrase of log2(2) bits; repeated rows are scored alike; texts of any length are read whole on both sides.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenix.llm import common
from lumenix.sources.tables import spread


@dataclass(frozen=True)
class CrossParseParams:
    """Text of a unit (``unit_bytes`` x ``held_units``) and hashes that meet in a task (at eight for each word, twice
    ``shard_bytes`` x ``held_shards`` bytes, 1 MB at least); results do not depend on them. ``piece_words`` has no effect:
    texts are not cut."""

    shard_bytes: int = 400_000
    unit_bytes: int = 4_000_000
    piece_words: int = 2000
    held_shards: int = 24
    held_units: int = 2


def suffix_automaton(symbols: Sequence[Hashable]) -> list[dict]:
    """Transitions of the smallest automaton of all factors of ``symbols``; state 0 is the start."""
    nxt: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def cross_phrases(automaton: list[dict], symbols: Sequence[Hashable]) -> tuple[int, int]:
    """Phrases of the greedy longest-match parse, and the length of the longest match."""
    start, state, at, phrases, longest = automaton[0], automaton[0], 0, 0, 0
    for c in symbols:
        to = state.get(c)
        if to is not None:
            at += 1
            state = automaton[to]
            continue
        if at:
            phrases += 1
            longest = max(longest, at)
            to = start.get(c)
        if to is None:
            phrases += 1
            at, state = 0, start
        else:
            at, state = 1, automaton[to]
    return phrases + (at > 0), max(longest, at)


def self_phrases(symbols: Sequence[Hashable]) -> int:
    """Phrases of the incremental parse: each is the longest earlier phrase and one more symbol."""
    seen: dict = {}
    node, count = 0, 0
    for c in symbols:
        to = seen.get((node, c))
        if to is None:
            count += 1
            seen[node, c] = count
            node = 0
        else:
            node = to
    return count + (node != 0)


def coded_self_phrases(codes: Sequence[int], size: int) -> int:
    """``self_phrases`` of codes below ``size``; a node and a symbol are one number."""
    seen: dict[int, int] = {}
    put = seen.setdefault
    node, new = 0, size
    for c in codes:
        node = put(node + c, new)
        if node == new:
            new += size
            node = 0
    return new // size - 1 + (node != 0)


def relative_entropy(cross: int, own: int, n: int, reference: int) -> float:
    if not n:
        return 0.0
    return (cross * math.log2(reference + 2) - own * math.log2(max(own, 1))) / n


def sorted_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and the sorted keys: places are sorted as the last bits of keys, in half of argsort's time."""
    bits = np.uint64(len(keys).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).view(np.int64)
    keys = keys[order]
    wrong = np.flatnonzero(keys[1:] < keys[:-1])
    if len(wrong):  # keys that differ in the last bits only
        lead = keys >> bits
        run = np.cumsum(np.append(True, lead[1:] != lead[:-1]))
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[wrong]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at][np.argsort(keys[at])]
        keys[at] = np.sort(keys[at])
    return order, keys


def met_elsewhere(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which ``keys`` are on the other side with another owner; the first ``n`` are one side, the rest the other. All are sorted
    once: a search for each in the others, in no order, takes several times as long."""
    found = np.zeros(len(keys), bool)
    if not 0 < n < len(keys):
        return found
    if not 0.1 < n / len(keys) < 0.9:  # few of the larger side can be on the smaller
        small, large = (slice(n), slice(n, None)) if 2 * n < len(keys) else (slice(n, None), slice(n))
        shift = np.uint64(64 - min(len(keys[small]).bit_length() + 3, 24))
        spread = keys * common._P  # all keys of a part begin alike
        there = np.zeros(1 << (64 - int(shift)), bool)
        there[spread[small] >> shift] = True
        keep = np.ones(len(keys), bool)
        keep[large] = there[spread[large] >> shift]
        if not keep.all():
            found[keep] = met_elsewhere(keys[keep], owner[keep], int(keep[:n].sum())) if keep[large].any() else False
            return found
    order, keys = sorted_order(keys)
    same = keys[1:] == keys[:-1]
    keep = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if not len(keep):
        return found
    first = np.flatnonzero(~np.append(False, same)[keep])
    order = order[keep]
    owner, sizes = owner[order], np.diff(np.append(first, len(order)))
    many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    keep, sizes = np.repeat(many, sizes), sizes[many]
    order, owner = order[keep], owner[keep]
    if not len(order):
        return found
    first, hit = np.cumsum(sizes) - sizes, np.zeros(len(order), bool)
    for there in (order < n, order >= n):
        least = np.minimum.reduceat(np.where(there, owner, 2**63 - 1), first)
        most = np.maximum.reduceat(np.where(there, owner, -(2**63)), first)  # below least if no owner is there
        more, one = np.repeat(least < most, sizes), np.repeat(least == most, sizes)
        hit |= ~there & (more | (one & (np.repeat(least, sizes) != owner)))
    found[order] = hit
    return found


def greedy_phrases(longest: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cross_phrases`` of each of the texts of ``sizes`` words that follow each other, from the longest match at each position.
    All texts take a step at once; the last, which are long, are walked one by one."""
    phrases, most = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    end = np.cumsum(sizes)
    step = np.maximum(longest, 1)
    text = np.flatnonzero(sizes)
    at, stop = (end - sizes)[text], end[text]
    while len(text) > 100:
        phrases[text] += 1
        most[text] = np.maximum(most[text], longest[at])
        at = at + step[at]
        on = at < stop
        if not on.all():
            text, at, stop = text[on], at[on], stop[on]
    for k, i, j in zip(text.tolist(), at.tolist(), stop.tolist()):
        each, n, x, path = step[i:j].tolist(), j - i, 0, []
        while x < n:
            path.append(x)
            x += each[x]
        phrases[k] += len(path)
        most[k] = max(most[k], longest[i:j][path].max())
    return phrases, most


def _hashed(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    raw, off = common.text_bytes(column)
    for i, j in common.blocks(off, 1 << 18):  # arrays that stay in the cache
        part = raw[off[i] : off[j]]
        s, e, first = common.word_bounds(part, off[i : j + 1] - off[i])
        h = common.hash_spans(part, s, e, True)
        yield from (h[first[r] : first[r + 1]] for r in range(j - i))


def _pack(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> object:
    return pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


class Unit:
    """Texts of documents, or of the reference, and what is known of each word position.

    ``longest`` is the longest gram found so far from a position on. Words out of which no longer gram can come are dropped by
    ``compact``; what is left are segments of texts. ``full`` keeps the lengths of all positions, ``at`` their places in it.
    ``entries`` are the searches under way: position, length known to occur, and how many words above it do not occur.
    """

    def __init__(self, documents: bool, texts: list[np.ndarray], owners: list[int], ids: list | None = None, kind: pa.DataType | None = None):
        self.documents, self.ids, self.kind = documents, ids, kind
        self.owners = np.array(owners, np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        coded = pa.array(np.concatenate([np.zeros(0, np.uint64), *texts])).dictionary_encode()
        words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # small codes for frequent words, as they are stored
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.vocabulary, self.codes = words[order], rank[codes]
        ends = np.cumsum(self.sizes).tolist()
        self.own = [coded_self_phrases(self.codes[e - n : e].tolist(), len(words)) for e, n in zip(ends, self.sizes.tolist())] if documents else None
        self.segments, self.segment_text = self.sizes, np.arange(len(texts), dtype=np.int32)
        self.longest = np.zeros(len(codes), np.uint8)
        self.at = self.full = self.exact = self._sums = None
        self.entries = np.zeros((3, 0), np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sums": None, "codes": np.ascontiguousarray(self.codes.view(np.uint8).reshape(-1, 4).T)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"codes": np.ascontiguousarray(state["codes"].T).view(np.int32).reshape(-1)}

    @property
    def text(self) -> np.ndarray:
        return np.repeat(self.segment_text, self.segments)

    @property
    def left(self) -> np.ndarray:
        return np.repeat(np.cumsum(self.segments), self.segments) - np.arange(len(self.codes))

    def grams(self):
        """A function that gives the hashes of grams of ``n`` words (a number or an array) from positions on, or from a slice of
        them."""
        if self._sums is None:
            words = self.vocabulary[self.codes]
            self._sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * common._powers(max(len(words), 1))[0][: len(words)], out=self._sums[1:])
        total, down = self._sums, common._powers(max(len(self.codes), 1))[1]
        return lambda at, n: (total[slice(at.start + n, at.stop + n) if isinstance(at, slice) else at + n] - total[at]) * down[at]

    def asks(self, stage: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions (in ``entries``, once they are used) and the hashes they ask for, in parts of one length or step."""
        if not len(self.codes) or stage == "1":
            return []
        grams, left, out = self.grams(), self.left, []
        if stage in ("first", "search"):
            at, known, span = self.entries
            step, room = np.maximum(1, span // STEPS), left[at]
            for j in range(1 if stage == "first" else STEPS):
                n = known + step * j
                ok = np.flatnonzero((step * j < span) & (room >= n))
                node = _salt(known[ok] << 32 | span[ok] << 4 | j)  # j < 16 and spans are below 2^28
                out.append((ok, common.mix64(grams(at[ok], n[ok]) + node)))
            return out
        known, lengths = GRAMS[stage]
        place = np.arange(len(self.codes))
        ends = np.minimum.accumulate(np.where(self.longest >= known, len(place), place)[::-1])[::-1]
        run = np.minimum(ends - place, left - known + 1)
        for n in lengths or [16 << k for k in range(int(run.max() + known).bit_length())]:
            at = np.flatnonzero(run >= n - known + 1)
            if not len(at):
                break
            salt, keys = _salt(np.array([n])), np.empty(len(at), np.uint64)
            for i in range(0, len(at), 1 << 14):  # arrays that stay in the cache
                some = at[i : i + (1 << 14)]
                a, b = int(some[0]), int(some[-1]) + 1
                if b - a < 2 * len(some):  # slices are faster than places
                    some, every = some - a, grams(slice(a, b), n)
                    keys[i : i + (1 << 14)] = common.mix64((every + salt)[some])
                else:
                    keys[i : i + (1 << 14)] = common.mix64(grams(some, n) + salt)
            out.append((at, keys))
        return out

    def learn(self, stage: str, asked: list[tuple[np.ndarray, np.ndarray]], found: list[np.ndarray]) -> None:
        """Take the answers to what ``asks`` gave."""
        if stage in ("first", "search"):
            at, known, span = self.entries
            hits = np.zeros((STEPS, len(at)), bool)
            for j, ((ok, _), hit) in enumerate(zip(asked, found)):
                hits[j, ok] = hit
            step = np.maximum(1, span // STEPS)
            if stage == "first":
                self.entries = self.entries if self.documents else self.entries[:, hits[0]]
            elif self.documents:
                best = STEPS - 1 - np.argmax(hits[::-1], axis=0)
                known = np.where(hits.any(axis=0), known + step * best, known)
                done = step == 1
                self.longest[at[done]] = known[done]
                self.exact[at[done]] = True
                self.entries = np.stack([at, known, step])[:, ~done]
            else:  # who searches here may end below any of the lengths met, or below the first of them
                hits[:, ~hits[0] | (step == 1)] = False
                j, i = np.nonzero(hits)
                self.entries = np.stack([at[i], known[i] + step[i] * j, step[i]])
            return
        if stage == "16":
            self.longest = self.longest.astype(np.int32)
        for (at, _), hit, n in zip(asked, found, GRAMS[stage][1] or [16 << k for k in range(len(asked))]):
            self.longest[at[hit]] = n
        if stage == "16":
            self.exact = self.longest < 8
        else:
            self.compact(GRAMS[stage][1][-1])

    def compact(self, n: int) -> None:
        """Keep the words of grams of ``n`` words that were found."""
        if self.documents:
            if self.full is None:
                self.full, self.at = self.longest.copy(), np.arange(len(self.codes), dtype=np.int32)
            else:
                self.full[self.at] = self.longest
        first = np.flatnonzero(self.longest >= n)
        cover = np.zeros(len(self.codes) + 1, np.int64)
        cover[first] += 1
        cover[first + n] -= 1
        keep = np.flatnonzero(np.cumsum(cover[:-1]))
        part, text = np.repeat(np.arange(len(self.segments)), self.segments)[keep], self.text[keep]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(keep) > 1) | (np.diff(part) > 0)])[: len(keep)])
        self.segments, self.segment_text = np.diff(np.append(begin, len(keep))), text[begin]
        self.codes, self.longest, self._sums = self.codes[keep], self.longest[keep], None
        used = np.zeros(len(self.vocabulary), bool)
        used[self.codes] = True
        self.vocabulary, self.codes = self.vocabulary[used], (np.cumsum(used, dtype=np.int32) - np.int32(1))[self.codes]
        if self.documents:
            self.at = self.at[keep]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest place at which the longest match of each position may end."""
        place, left = np.arange(len(self.codes)), self.left
        most = np.minimum(np.where(self.exact, self.longest, 2 * self.longest - 1), left)
        low = np.maximum.accumulate(place + np.minimum(self.longest, left))
        return low, np.minimum.accumulate((place + most)[::-1])[::-1]

    def start(self, every: bool) -> None:
        """Begin a search between a power of two and the next: of the documents' open positions, the first of each stretch or
        all; of the reference, wherever a power of two was found."""
        if self.documents:
            low, high = self.bounds()
            opened = (low < high) & ~self.exact
            if not every:
                opened[1:] &= ~(opened[:-1] & (high[1:] == high[:-1]))
            at = np.flatnonzero(opened)
            self.entries = np.stack([at, self.longest[at], self.longest[at]]).astype(np.int64)
        else:
            each = [np.flatnonzero(self.longest >= 8 << k) for k in range(int(self.longest.max(initial=0)).bit_length())]
            power = np.repeat([8 << k for k in range(len(each))], [len(e) for e in each]).astype(np.int64)
            self.entries = np.stack([np.concatenate([np.zeros(0, np.int64), *each]), power, power])

    def scored(self, n_reference: int) -> pa.RecordBatch:
        full = self.full.astype(np.int64)
        low, high = self.bounds()
        far = np.flatnonzero(self.longest >= 8)
        assert (self.exact | (low == high))[far].all()
        full[self.at[far]] = low[far] - far
        parsed = zip(self.sizes.tolist(), *(x.tolist() for x in greedy_phrases(full, self.sizes)), self.own)
        rows = [(size, cross, own, most, relative_entropy(cross, own, size, n_reference)) for size, cross, most, own in parsed]
        columns = [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.float64()) for k in range(5)]
        return pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind), *columns], ["doc_id", "n_words", "cross_phrases", "self_phrases", "longest_match", "score"])


#: Parts into which a search cuts its interval in a round.
STEPS = 16
#: By stage: the length that must have been found all along, and the lengths asked for; none are the powers of two from 16 on.
GRAMS: dict[str, tuple[int, tuple[int, ...]]] = {"2": (1, (2,)), "3": (2, (3, 4)), "5": (4, (5, 6, 7, 8)), "16": (8, ())}


def _salt(x: np.ndarray) -> np.ndarray:
    return common.mix64(x.astype(np.uint64) + common._P)


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` by part of all hashes, the same for the same keys, and where each part begins."""
    part = ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint8 if parts <= 256 else np.uint16)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _messages(u: Unit, stage: str, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, what the unit asks of it); keys come with runs of owners, words of the first stage with least and greatest owner."""
    if stage == "1":
        keys = common.mix64(u.vocabulary)
        order, begin = _split(keys, parts)
        least, most = np.full(len(keys), 2**63 - 1), np.full(len(keys), -(2**63))
        if not u.documents:
            np.minimum.at(least, u.codes, u.owners[u.text])
            np.maximum.at(most, u.codes, u.owners[u.text])
        for q in range(parts):
            i = order[begin[q] : begin[q + 1]]
            if len(i):
                yield q, _pack((u.documents, keys[i]) if u.documents else (u.documents, keys[i], least[i], most[i]))
        return
    asked = u.asks(stage)
    if not asked:
        return
    keys = np.concatenate([k for _, k in asked])
    at = np.concatenate([a if stage not in ("first", "search") else u.entries[0][a] for a, _ in asked])
    order, begin = _split(keys, parts)
    text = u.text[at]
    for q in range(parts):
        i = order[begin[q] : begin[q + 1]]
        if len(i):
            t = text[i]
            runs = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            yield q, _pack((u.documents, keys[i], u.owners[t[runs]], np.diff(np.append(runs, len(t))).astype(np.int32)))


def _words_met(asked: list[tuple]) -> list[bytes]:
    """For words of documents: how many owners in the reference have them (two for more), and the owner if it is one."""
    given = [m for m in asked if not m[0]]
    keys, least, most = (np.concatenate([m[k] for m in given]) if given else np.zeros(0, np.uint64 if k == 1 else np.int64) for k in (1, 2, 3))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if len(first):
        keys, least, most = keys[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
    out = []
    for m in asked:
        if not m[0] or not len(keys):
            out.append(_pack((np.zeros(len(m[1]), np.uint8), np.zeros(len(m[1]), np.int64))))
            continue
        at = np.minimum(np.searchsorted(keys, m[1]), len(keys) - 1)
        n = (keys[at] == m[1]) * (1 + (least[at] != most[at])).astype(np.uint8)
        out.append(_pack((n, np.where(n == 1, least[at], 0))))
    return out


def _grams_met(asked: list[tuple]) -> list[bytes]:
    """Which of the grams of either side another owner has on the other."""
    order = sorted(range(len(asked)), key=lambda i: asked[i][0])  # the reference first
    sizes = [len(asked[i][1]) for i in order]
    n = sum(len(m[1]) for m in asked if not m[0])
    keys = np.concatenate([np.zeros(0, np.uint64), *(asked[i][1] for i in order)])
    owner = np.concatenate([np.zeros(0, np.int64), *(np.repeat(asked[i][2], asked[i][3]) for i in order)])
    asked.clear()  # they take as much memory again
    found, out, done = met_elsewhere(keys, owner, n), [b""] * len(order), 0
    for i, size in zip(order, sizes):
        out[i] = np.packbits(found[done : done + size]).tobytes()
        done += size
    return out


def _learn(u: Unit, stage: str, answers: dict[int, bytes], parts: int) -> None:
    if stage == "1":
        if not u.documents:
            u.longest[:] = 1
            return
        order, begin = _split(common.mix64(u.vocabulary), parts)
        n, owner = np.zeros(len(order), np.uint8), np.zeros(len(order), np.int64)
        for q, blob in answers.items():
            n[order[begin[q] : begin[q + 1]]], owner[order[begin[q] : begin[q + 1]]] = _unpack(blob)
        n, owner = n[u.codes], owner[u.codes]
        u.longest[:] = (n == 2) | ((n == 1) & (owner != u.owners[u.text]))
        return
    asked = u.asks(stage)
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in asked)])
    order, begin = _split(keys, parts)
    found = np.zeros(len(keys), bool)
    for q, blob in answers.items():
        i = order[begin[q] : begin[q + 1]]
        found[i] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(i)).astype(bool)
    u.learn(stage, asked, np.split(found, np.cumsum([len(k) for _, k in asked])[:-1]) if asked else [])


#: Units whose answers share a file.
GROUP = 8
#: Units (of part -1, with their number of words left) or messages and the answers to them, with the longest interval that documents
#: search; ``target`` is the group of units or the part that a row goes to.
ROWS = "target int, unit int, part int, asking long, body binary"


def _rows(rows: Iterator[tuple], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS``, of little more than ``most`` bytes."""
    held: list[tuple] = []
    schema = pa.schema([("target", pa.int32()), ("unit", pa.int32()), ("part", pa.int32()), ("asking", pa.int64()), ("body", pa.binary())])
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


@dataclass(frozen=True)
class Answered:
    """A round whose answers are written: whether all open positions search in it, and the file of each group of units."""

    stage: str
    every: bool
    parts: int
    files: dict[int, str]


def _answers(file: str) -> dict[int, dict[int, bytes]]:
    """By unit and part."""
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        rows = pq.ParquetFile(f).read(["unit", "part", "body"])
    out: dict[int, dict[int, bytes]] = {}
    for unit, part, body in zip(rows["unit"].to_pylist(), rows["part"].to_pylist(), rows["body"].to_pylist()):
        out.setdefault(unit, {})[part] = body
    return out


def _known(blob: bytes, unit: int, answered: list[Answered], held: dict[str, dict]) -> Unit:
    """A unit with what was answered since it was written. ``held`` has the answers to the group met last."""
    u = _unpack(blob)
    files = [a.files.get(unit // GROUP) for a in answered]
    for file in [f for f in held if f not in files]:
        del held[file]
    for a, file in zip(answered, files):
        if a.stage == "first":
            u.start(a.every)
        if file and file not in held:
            held[file] = _answers(file)
            assert {k // GROUP for k in held[file]} <= {unit // GROUP}  # a file may have no rows
        _learn(u, a.stage, held[file].get(unit, {}) if file else {}, a.parts)
    return u


def _units(texts: DataFrame, documents: bool, most: int) -> DataFrame:
    """``texts(doc_id, owner, text)`` as units of about ``most`` bytes, numbered within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            ids, words, owners, held, n = [], [], [], 0, 0
            partition, kind = TaskContext.get().partitionId(), None
            for batch in batches:
                off, kind = common.text_bytes(batch.column(2))[1], batch.schema.field(0).type
                for i, j in common.blocks(off, most):  # a batch may hold more text than a unit
                    part = batch.slice(i, j - i)
                    ids += part.column(0).to_pylist()
                    owners += part.column(1).to_pylist()
                    words += _hashed(part.column(2))
                    held += int(off[j] - off[i])
                    if held >= most:
                        yield partition, n, -1, sum(map(len, words)), _pack(Unit(documents, words, owners, ids if documents else None, kind))
                        ids, words, owners, held, n = [], [], [], 0, n + 1
            if words:
                yield partition, n, -1, sum(map(len, words)), _pack(Unit(documents, words, owners, ids if documents else None, kind))

        yield from _rows(cut())

    return texts.mapInArrow(run, ROWS)


def score(documents: DataFrame, reference: DataFrame, p: CrossParseParams = CrossParseParams()) -> DataFrame:
    """doc_id, n_words, cross_phrases, self_phrases, longest_match, score of every document.

    ``reference`` has doc_id and text like ``documents``; rows in both are kept apart by id and text.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    owner = F.xxhash64("doc_id", "text").alias("owner")
    size = p.unit_bytes * p.held_units
    of = [_written(_units(spread(t.select("doc_id", owner, "text")), k == 0, size), "units") for k, t in enumerate((documents, reference))]
    made = [[(k, r["target"], r["unit"], r["asking"]) for r in t.select("target", "unit", "asking").collect()] for k, t in enumerate(of)]
    n_reference = sum(r[3] for r in made[1])
    number = [(*r[:3], i) for i, r in enumerate(sorted(made[0] + made[1]))]
    groups = max(1, -(-len(number) // GROUP))
    left = sum(r[3] for r in made[0] + made[1])

    def parts_of(stage: str) -> int:
        """Tasks that answer: as many as the words that are left may need. Later stages ask more of each of fewer words."""
        each = {"1": 4, "2": 8, "3": 8, "5": 32, "16": 32}.get(stage, 16)
        return min(1 << 15, max(1, -(-each * left // max(1 << 20, 2 * p.shard_bytes * p.held_shards))))

    numbers = documents.sparkSession.createDataFrame(number, "side int, partition int, nth int, number int")

    def numbered(k: int) -> DataFrame:
        own = F.broadcast(numbers.where(F.col("side") == k))
        unit = F.col("number")
        return of[k].join(own, (F.col("target") == F.col("partition")) & (F.col("unit") == F.col("nth"))).select(unit.alias("target"), unit.alias("unit"), "part", "asking", "body")

    rows, written = numbered(0).unionByName(numbered(1)), of
    answered: list[Answered] = []

    def read() -> DataFrame:
        """The units, in no more tasks than the words that are left are worth."""
        return rows.coalesce(max(documents.sparkSession.sparkContext.defaultParallelism, left // 600_000))

    def answers_to(stage: str, every: bool, parts: int) -> DataFrame:
        """One round. Its answers are written in a file for each group of units."""
        before = list(answered)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[tuple]:
                held: dict = {}
                for batch in batches:
                    for unit, body in zip(batch.column(1).to_pylist(), batch.column(4)):
                        u = _known(body.as_py(), unit, before, held)
                        if stage == "first":
                            u.start(every)
                        asking = int(u.entries[2].max(initial=0)) if u.documents else 0
                        for q, blob in _messages(u, stage, parts):
                            yield q, unit, q, asking, blob

            yield from _rows(out())

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to, asked = [], []
            for batch in batches:
                for *row, body in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), batch.column(4)):
                    to.append((row[0] // GROUP, *row))
                    asked.append(_unpack(body.as_py()))
            if asked:
                yield from _rows((*row, blob) for row, blob in zip(to, (_words_met if stage == "1" else _grams_met)(asked)))

        asked = read().mapInArrow(ask, ROWS).repartitionById(parts, "target")
        return _written(asked.mapInArrow(answer, ROWS).repartitionById(groups, "target"), "answers")

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            held: dict = {}
            for batch in batches:
                for unit, body in zip(batch.column(1).to_pylist(), batch.column(4)):
                    u = _known(body.as_py(), unit, answered, held)
                    yield unit, unit, -1, len(u.codes), _pack(u)

        yield from _rows(out())

    def turn(stage: str, every: bool = False) -> int:
        """One round; the longest interval that documents search in it."""
        nonlocal rows, written, answered, left
        parts = parts_of(stage)
        got = answers_to(stage, every, parts)
        files = {int(re.search(r"part-(\d+)-[^/]*$", f)[1]): f for f in got.inputFiles()}
        asking = got.agg(F.max("asking")).first()[0] or 0 if stage == "first" else 0
        answered.append(Answered(stage, every, parts, files))
        written = [*written, got]
        if stage in ("2", "3", "5", "16", "first"):  # these change much; what later ones change is quickly done again
            rows = common.materialize(read().mapInArrow(learnt, ROWS), "units")
            left = rows.agg(F.sum("asking")).first()[0] or 0
            common.discard(*written)
            written, answered = [rows], []
        return asking

    for stage in ("1", "2", "3", "5", "16"):
        turn(stage)
    for every in (False, True):
        asking = turn("first", every)
        if not asking:
            break
        while asking > 1:
            turn("search")
            asking //= STEPS

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for unit, body in zip(batch.column(1).to_pylist(), batch.column(4)):
                u = _known(body.as_py(), unit, answered, held)
                if u.documents:
                    yield u.scored(n_reference)

    return rows.mapInArrow(finish, f"doc_id {kind}, n_words long, cross_phrases long, self_phrases long, longest_match long, score double")


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` by ``materialize``. The files of its shuffles are deleted at once: the driver's garbage collector would leave them
    until after the next table is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return common.materialize(df, label)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def good_reference(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled good and not toxic. Labels grow with the corpus, so the join is by shuffle at any size."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").alias("good_id")).distinct()
    return documents.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi")
