"""Pieces without Spark, against brute force."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumenix.llm import bitsliced, bpe, common, cross_parsing, language_id, minhash, packing, quality, toxicity

ODD = " \n\t  'sabcÉ12.!|é中 \r\x0b<|endoftext|>\U0001f600"


def text(rng, n, alphabet=ODD):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


def test_word_bounds_are_the_pattern_s():
    import re

    rng = random.Random(0)
    rows = [text(rng, 40) for _ in range(300)] + [None, "", "   ", "x" * 5000]
    raw, off = common.text_bytes(pa.array(rows, pa.string()))
    s, e, first = common.word_bounds(raw, off)
    got = [[raw[a:b].tobytes() for a, b in zip(s[lo:hi], e[lo:hi])] for lo, hi in zip(first, first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (r or "").encode()) for r in rows]
    h = common.hash_spans(raw, s, e, True)
    words = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for g in got for w in g]
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))


def test_cross_parse_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(500):
        a, b = text(rng, 30, "abc"), text(rng, 30, "abcd")
        i = phrases = longest = 0
        while i < len(b):
            j = i
            while j < len(b) and b[i : j + 1] in a:
                j += 1
            longest, phrases, i = max(longest, j - i), phrases + 1, max(j, i + 1)
        assert cross_parsing.cross_phrases(cross_parsing.suffix_automaton(a), b) == (phrases, longest)


def test_self_parse():
    assert [cross_parsing.self_phrases(x) for x in ("", "a", "aa", "aaa", "abab", "aabab")] == [0, 1, 2, 2, 3, 3]
    assert cross_parsing.relative_entropy(0, 0, 0, 5) == 0


def parse(texts, reference, parts=3):
    """(cross phrases, longest match) of each text by the rounds of ``cross_parsing``, and how many hashes were asked."""
    made = [cross_parsing.Unit(k < 2, [t for _, t in rows], [o for o, _ in rows], [o for o, _ in rows], pa.int64()) for k, rows in enumerate((texts[::2], texts[1::2], reference[::2], reference[1::2]))]
    asked = 0

    def turn(stage):
        nonlocal asked
        sent = [list(cross_parsing._messages(u, stage, parts)) for u in made]
        answers = [{} for _ in made]
        for q in range(parts):
            to = [(k, cross_parsing._unpack(m)) for k, ms in enumerate(sent) for at, m in ms if at == q]
            asked += sum(len(m[1]) for _, m in to)
            for (k, _), a in zip(to, (cross_parsing._words_met if stage == "1" else cross_parsing._grams_met)([m for _, m in to])):
                answers[k][q] = a
        for k, u in enumerate(made):
            cross_parsing._learn(u, stage, answers[k], parts)
            made[k] = cross_parsing._unpack(cross_parsing._pack(u))

    for stage in ("1", "2", "3", "5", "16"):
        turn(stage)
    searched = []
    for every in (False, True):
        for u in made:
            u.start(every)
        span = max(int(u.entries[2].max(initial=0)) for u in made if u.documents)
        searched.append(span)
        turn("first")
        while span > 1:
            turn("search")
            span //= cross_parsing.STEPS
    scored = [u.scored(1).to_pydict() for u in made[:2]]
    got = {i: r for d in scored for i, r in zip(d["doc_id"], zip(d["cross_phrases"], d["longest_match"]))}
    return got, asked, searched


def patchwork(rng, family, n):
    """Texts of pieces of a common text and of few words between, so that matches of all lengths overlap."""
    common_text = rng.integers(1, 2**63, 600, dtype=np.uint64)
    few = rng.integers(1, 2**63, 6, dtype=np.uint64)
    out = []
    for i in range(n):
        pieces = []
        for _ in range(rng.integers(0, 6)):
            at = rng.integers(0, 600)
            pieces += [common_text[at : at + rng.integers(1, 250)], rng.choice(few, rng.integers(0, 30))]
        out.append((family * 1000 + i, np.concatenate([np.zeros(0, np.uint64), *pieces])))
    return out


def test_cross_parsing_rounds_give_the_automatons_matches():
    late = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        texts = patchwork(rng, seed, 14)
        reference = texts[3:12] + texts[5:7]  # repeated rows are one owner
        got, _, searched = parse(texts, reference)
        late += searched[1] > 0
        for i, t in texts:
            symbols = [w for j, u in reference if j != i for w in (*u.tolist(), ("end", j))]
            assert got[i] == cross_parsing.cross_phrases(cross_parsing.suffix_automaton(symbols), t.tolist())
    assert late


def test_cross_parsing_work_grows_with_the_table():
    """Twice the documents and twice the reference ask for about twice the hashes, not for four times as many."""
    families = [patchwork(np.random.default_rng(20 + k), k, 20) for k in range(8)]
    half, whole = (parse([r for f in families[:k] for r in f], [r for f in families[:k] for r in f[::2]])[1] for k in (4, 8))
    assert whole < 2.5 * half


def test_cross_parsing_finds_grams_of_other_owners():
    """Brute force, also of keys that differ in their last bits only, and of sides of very different size."""
    rng = np.random.default_rng(3)
    for seed in range(60):
        keys = rng.integers(0, 40, rng.integers(2, 300)).astype(np.uint64) << np.uint64((0, 3, 50)[seed % 3])
        owner, n = rng.integers(-3, 3, len(keys)), int(rng.integers(0, len(keys) + 1)) if seed % 2 else 1 + seed % 4
        order, ordered = cross_parsing.sorted_order(keys)
        assert (keys[order] == ordered).all() and (np.sort(keys) == ordered).all()
        sides = [set(zip(keys[i].tolist(), owner[i].tolist())) for i in (slice(n, None), slice(n))]
        want = [any(k == x and o != y for x, y in sides[i >= n]) for i, (k, o) in enumerate(zip(keys.tolist(), owner.tolist()))]
        assert cross_parsing.met_elsewhere(keys, owner, n).tolist() == want


def test_cross_parsing_walks_all_texts_of_a_unit():
    rng = np.random.default_rng(4)
    for n in (0, 3, 400):
        texts = [rng.integers(0, 9, rng.integers(0, 40)) for _ in range(n)]
        longest = [np.minimum(rng.integers(0, 7, len(t)), len(t) - np.arange(len(t))) for t in texts]
        got = cross_parsing.greedy_phrases(np.concatenate([np.zeros(0, np.int64), *longest]), np.array([len(t) for t in texts], np.int64))
        for k, most in enumerate(longest):
            i, path = 0, []
            while i < len(most):
                path.append(int(most[i]))
                i += path[-1] or 1
            assert (got[0][k], got[1][k]) == (len(path), max(path, default=0))
        assert [cross_parsing.coded_self_phrases(t.tolist(), 9) for t in texts] == [cross_parsing.self_phrases(t.tolist()) for t in texts]


def test_bitsliced_scores_and_top():
    rng = np.random.default_rng(0)
    for n, d, m in ((5, 3, 9), (300, 8, 1025), (70, 64, 1024), (1, 1, 1)):
        v = rng.integers(-m, m, (n, d))
        v[: n // 3] = v[0]  # ties
        slices = [bitsliced.bitmaps(v[:, j]) for j in range(d)]
        for q in (rng.integers(-m, m + 1, d), np.zeros(d, int)):
            out = bitsliced.score_slices(slices, q)
            allowed = np.packbits(np.arange(out.shape[1] * 64) < n, bitorder="little").view(np.uint64)
            want = sorted(range(n), key=lambda r: (-(v[r] @ q), r))[:10]
            assert sorted(bitsliced.top_rows(out, allowed, 10)) == sorted(want)


def test_piece_encoder_equals_both_libraries(monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    rng = random.Random(3)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc, pieces = bpe.encoder(path, P.PATTERN)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    mine, slow = packing.encoder(P.path("byte_bpe_50k.json")), packing.library_encoder(P.path("byte_bpe_50k.json"))
    assert packing.as_ranks(P.path("byte_bpe_50k.json"))
    for _ in range(2000):
        t = text(rng, 120)
        assert pieces.packed(t) == np.asarray(enc.encode_ordinary(t), "<u4").tobytes()
        assert mine.packed(t) == slow.packed(t) == np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(bpe, "RUN", 5)  # cut out nearly all runs of white space
    blanks = "  \t\n\n\r\x0b\x0c\x85\xa0\u3000\u2028\x1c\x1fa'.1中"
    for _ in range(2000):
        t = text(rng, 120, blanks)
        assert pieces.packed(t) == np.asarray(enc.encode_ordinary(t), "<u4").tobytes()
        assert mine.packed(t) == np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    full = bpe.PieceEncoder(lambda p: [enc.encode_ordinary(x) for x in p], entries=3)
    for t in ("the cat sat on the mat " * 30, "a b c d e f g h", ""):
        assert full.packed(t) == np.asarray(enc.encode_ordinary(t), "<u4").tobytes()


def test_added_tokens_stand_for_their_ids():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mine = packing.encoder(P.path("byte_bpe_50k.json"))
    for t in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|>  x<|endoftext| >", "plain"):
        assert mine.packed(t) == np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_packer_keeps_every_id_once(seed):
    rng = random.Random(seed)
    p = packing.PackParams(capacity=64, open_windows=4)
    out = []
    packer = packing.Packer(p, out.append)
    docs = {k: np.arange(rng.choice([1, 3, 64, 65, 40, 200]), dtype="<u4").tobytes() for k in range(100)}
    for k, ids in docs.items():
        packer.add((k, 0, ids, len(ids) // 4))
        assert len(packer.room) <= 4
    packer.finish()
    pieces = sorted((p for s in out for p in s), key=lambda p: (p[0], p[1]))
    back = {}
    for k, start, ids, total in pieces:
        assert start == len(back.get(k, b"")) // 4 and total == len(docs[k]) // 4
        back[k] = back.get(k, b"") + ids
    assert back == docs
    sizes = [sum(len(p[2]) // 4 for p in s) for s in out]
    assert all(n & (n - 1) == 0 and n <= 64 for n in sizes)


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("unit, n", [(" ", 5_000_000), ("\n", 2_500_000), ("\t ", 1_000_000), ("\r\n", 800_000), ("\u3000", 1_200_000), ("a", 2_000_000), ("-", 1_000_000), ("ab\n", 400_000), ("中", 500_000)])
def test_long_runs_survive(unit, n):
    """The library alone overflows its stack on a million white-space characters; the other library does not."""
    enc, pieces = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in (unit * n, "x" + unit * n + "y", unit * n + "<|endoftext|>z"):
        ids = pieces.packed(t)
        assert enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()) == t.encode()
    t = "x" + unit * (n // 4) + "y<|endoftext|>" + unit * (n // 4)
    assert packing.encoder(P.path("byte_bpe_50k.json")).packed(t) == np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_runs_near_the_library_s_limit_have_its_ids():
    enc, pieces = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in (" " * 600_000, "x" + " \n" * 200_000 + "y", "\n" * 300_000 + " z"):
        assert pieces.packed(t) == np.asarray(enc.encode_ordinary(t), "<u4").tobytes()


def test_band_keys_find_similar_sets():
    rng = np.random.default_rng(2)
    p = minhash.MinHashParams()
    missed = 0
    for n in (5, 10, 40, 400):
        for _ in range(60):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = np.concatenate([base[: int(np.ceil(n * 0.9))], rng.integers(0, 2**63, n // 10).astype(np.uint64)])
            assert jaccard({*base.tolist()}, {*other.tolist()}) >= 0.8
            k = minhash.band_keys(minhash.signature([np.unique(base), np.unique(other)], p.bands * p.band_rows), p)
            missed += not (k[0] == k[1]).any()
    assert not missed
    a = minhash.band_keys(minhash.signature([np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(50)], p.bands * p.band_rows), p)
    assert len(np.unique(a)) == a.size


def test_shingles():
    raw, off = common.text_bytes(pa.array(["A b c d e", "a B\tC\nd e", "a b", "b a", "", None, "a b c d e f"], pa.string()))
    s = minhash.shingle_sets(raw, off, 5)
    assert [len(x) for x in s] == [1, 1, 1, 1, 0, 0, 2]
    assert s[0] == s[1] and s[2] != s[3] and s[0][0] in s[6]
    assert minhash.fingerprint(s[0]) == minhash.fingerprint(s[1]) != minhash.fingerprint(s[6])


def test_gradients_match_finite_differences():
    p = toxicity.ToxicityParams(window=5, word_buckets=64, char_buckets=64, word_width=3, char_width=3, hidden=3, attention=2)
    m = {k: v.astype(np.float64) for k, v in toxicity.init(p).items()}
    raw, off = common.text_bytes(pa.array(["ab cd ef gh ij", "ab x"], pa.string()))
    s, e, first = common.word_bounds(raw, off)
    words, number = toxicity.distinct_words(raw, s, e, p)
    start, length, _ = toxicity.windows(first, p)
    order, idx, live = toxicity.layout(start, length, number)
    y = np.array([1.0, 0.0])[order]

    def loss():
        z = toxicity.forward(m, toxicity.embed(m, words), idx, live, length[order])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = toxicity.gradients(m, words, idx, live, length[order], y)
    rng = np.random.default_rng(0)
    for k, v in m.items():
        flat = v.reshape(-1)
        where = np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-5)
        for i in rng.choice(where, min(4, len(where)), replace=False) if len(where) else []:
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g[k].reshape(-1)[i]) < 2e-3 * max(0.05, abs(g[k].reshape(-1)[i])), (k, i)


def test_attention_gradients():
    p = quality.QualityParams(hidden=4, attention=3)
    m = {k: v.astype(np.float64) for k, v in quality.init(7, p).items()}
    rng = np.random.default_rng(1)
    x, start, y = rng.normal(size=(9, 7)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = quality.forward(m, x, start)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = quality.gradients(m, x, start, y, np.ones(3))
    for k, v in m.items():
        flat = v.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-5


def test_windows_cover_all_words():
    p = toxicity.ToxicityParams(window=40, stride=24)
    first = np.array([0, 0, 1, 41, 105, 5000])
    start, length, row = toxicity.windows(first, p)
    for r, (lo, hi) in enumerate(zip(first, first[1:])):
        mine = np.zeros(hi - lo, bool)
        for s, n in zip(start[row == r], length[row == r]):
            mine[s - lo : s - lo + n] = True
        assert mine.all()


def test_passages_of_each_row_are_independent():
    rows = ["one two three " * 50, None, "", "X!! Y!! " * 100, "a"]
    raw, off = common.text_bytes(pa.array(rows, pa.string()))
    x, start = quality.passage_features(raw, off, 64)
    assert np.diff(start).tolist() == [3, 1, 1, 4, 1]
    for k, r in enumerate(rows):
        raw1, off1 = common.text_bytes(pa.array([r], pa.string()))
        np.testing.assert_allclose(quality.passage_features(raw1, off1, 64)[0], x[start[k] : start[k + 1]], atol=1e-6)


def test_ngrams_of_long_texts_are_counted_whole(monkeypatch):
    p = language_id.LanguageParams()
    t = "Äpfel und Birnen, 12 Stück. " * 30_000 * 2
    at, n = language_id.ngram_counts(t, p)
    assert int(n.sum()) == len(t) + (len(t) - 1) + (len(t) - 2)
    assert language_id.ngram_counts("12 .!", p) is None and language_id.ngram_counts("", p) is None


def test_constant_models_without_two_labels():
    col = pa.array(["a b", None, ""], pa.string())
    assert quality.fit([], quality.QualityParams()) == 0.5 and toxicity.fit([("x", 0)]) == 0.0
    assert quality.scores(1.0, col, quality.QualityParams()).tolist() == [1, 1, 1]
    assert toxicity.scores(0.0, col, toxicity.ToxicityParams()).tolist() == [0, 0, 0]


def test_punctuation_around_words_does_not_hide_them():
    p = toxicity.ToxicityParams()
    raw, off = common.text_bytes(pa.array(["Scum SCUM!! *scum*, “scum” don't !!! ***"]))
    s, e, _ = common.word_bounds(raw, off)
    words, number = toxicity.distinct_words(raw, s, e, p)
    assert number[0] == number[1] == number[2] and len({*number.tolist()}) == 5
    a, b = toxicity.bare(raw, s, e)
    assert [raw[i:j].tobytes().decode() for i, j in zip(a, b)] == ["Scum", "SCUM", "scum", "“scum”", "don't", "!!!", "***"]


def test_equal_bins_counted_either_way():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2, (70, 256)).astype(np.uint8)
    sig[5] = sig[40]
    i = np.arange(3, 35)
    x, y = np.nonzero(np.ones((32, 70), bool))
    want = (sig[i[x]] == sig[y]).sum(1)
    assert (minhash.equal_bins(sig, np.ascontiguousarray(sig.T), i, x, y) == want).all() and want.max() == 256
    assert (minhash.equal_bins(sig, np.ascontiguousarray(sig.T), i, x[:50], y[:50]) == want[:50]).all()


@pytest.mark.parametrize("spread", [8, 60, 4000])
def test_overlaps_and_links_of_a_cell(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    pool = np.concatenate([base, rng.integers(0, 2**63, spread).astype(np.uint64)])
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.1], rng.choice(pool, 6)])) for _ in range(90)] + [np.unique(rng.choice(pool, 4)) for _ in range(90)]
    sets = [sets[i] for i in rng.permutation(180)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (minhash.overlaps(sets, sets) == both).all()
    assert (minhash.overlaps(sets[:70], sets[70:]) == both[:70, 70:]).all()
    size = both.diagonal()
    near = 100 * both >= 80 * (size[:, None] + size - both)
    for late in ([False] * 180, [False] * 70 + [True] * 110):
        asked = near if not any(late) else near & (np.array(late)[:, None] != np.array(late))
        links = minhash.linked(late, [bytes([k]) for k in range(180)], sets, minhash.MinHashParams())
        assert all(asked[a[0], b[0]] for a, b in links)
        reach = np.linalg.matrix_power((asked | np.eye(180, dtype=bool)).astype(float), 16) > 0
        parts = np.eye(180, dtype=bool)
        for a, b in links:  # each joins two parts: a forest
            assert not parts[a[0], b[0]]
            parts |= np.outer(parts[a[0]] | parts[b[0]], parts[a[0]] | parts[b[0]])
        assert (parts == (np.linalg.matrix_power(reach.astype(float), 16) > 0)).all()
