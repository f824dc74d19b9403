"""Column functions and word scans, on tables of cases."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenix.functions import declaration as decl
from lumenix.functions import identity
from lumenix.functions import text as tx
from lumenix.functions import vectors as vec
from lumenix.sources import files


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b c d", []),
        ("é a", ["é"]),
        ("refresh_token", ["refresh", "token", "refresh_token"]),
        ("sessionToken", ["session", "token", "sessiontoken"]),
        ("HTTPServer2Go", ["httpserver2", "go", "httpserver2go"]),
        ("__", ["__"]),
        ("_x", ["_x"]),
        ("x1Y", ["x1", "x1y"]),
        ("Word", ["word"]),
        ("one-two it's", ["one", "two", "it"]),
        ("Straße über_Maß", ["straße", "über", "maß", "über_maß"]),
    ],
)
def test_terms(spark, text, want):
    assert one(spark, text, tx.terms) == want


def test_frequencies_round_trip(spark):
    df = spark.createDataFrame([({"b": 2, "a": 1, "c": 30},)], "m map<string,bigint>")
    coded = df.select(tx.encode_frequencies(F.col("m")).alias("d"))
    assert coded.first()["d"] == "a b:2 c:30"
    back = coded.select(F.explode(tx.decode_frequencies(F.col("d"))).alias("x")).select("x.term", "x.tf").collect()
    assert {(r[0], r[1]) for r in back} == {("a", 1), ("b", 2), ("c", 30)}
    odd = one(spark, "  x:y  z: w:5:6 ", tx.decode_frequencies)
    assert [(r["term"], r["tf"]) for r in odd] == [("x", 1), ("z", 1), ("w", 1)]


def test_newlines_and_lines(spark):
    assert one(spark, "a\r\nb\rc\n\r", tx.normalize_newlines) == "a\nb\nc\n\n"
    assert one(spark, "a\r\nb\n", tx.lines) == ["a", "b"]
    assert one(spark, "", tx.lines) == []


@pytest.mark.parametrize(("start", "end", "want"), [(0, 1, "a"), (1, 2, ""), (1, 3, "é"), (2, 4, "éb"), (3, 99, "b中"), (3, 2, ""), (4, 6, ""), (5, 7, "中"), (-3, 1, "a")])
def test_slices_never_split_characters(spark, start, end, want):
    assert one(spark, "aéb中", lambda c: tx.slice_bytes(c, F.lit(start), F.lit(end))) == want


def test_line_of(spark):
    got = [one(spark, "ab\ncé\n", lambda c, o=o: tx.line_of(c, F.lit(o))) for o in (0, 2, 3, 6, 7, 50)]
    assert got == [1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize(("key", "ok"), [("a/b.txt", True), ("", False), ("/a", False), ("a\\b", False), ("c:/x", False), ("a/b:c", True), ("a/../b", False), ("./a", False), ("a//b", False), ("a/", False), ("a\tb", False), ("é/ß", True)])
def test_safe_keys(spark, key, ok):
    assert one(spark, key, tx.safe_key) is ok


def test_display(spark):
    assert one(spark, "a\x1b[1m\nb", tx.terminal_safe) == "a\\u{1b}[1m\\nb"
    assert one(spark, " a \n\tb​c‮d ", tx.quoted) == "a bcd"
    assert one(spark, "x" * 300, tx.quoted) == "x" * 240 + "…"
    shown = one(spark, "\n".join("abcdef"), lambda c: tx.snippet(c, F.lit(5), F.lit(10), 4))
    assert shown.split("\n") == ["[TRUNCATED 4 lines before]", *"abcd", "[TRUNCATED 2 lines after]"]


def test_content(spark):
    raw = [(0, b"a\r\nb"), (1, b"a\x00b"), (2, b"\xff\xfe"), (3, b"\xef\xbb\xbfx"), (4, b"a" * 8000 + b"\x00"), (5, b"a" * 7999 + b"\x00")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in raw], "i int, b binary")
    got = {r["i"]: r["t"] for r in df.select("i", tx.content_or_null(F.col("b")).alias("t")).collect()}
    assert (got[0], got[1], got[2], got[3], got[5]) == ("a\nb", None, None, "\ufeffx", None) and len(got[4]) == 8001


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("fn parse(x: u8) {", "parse"),
        ("    pub async fn run<T>(", "run"),
        ("const LIMIT: usize = 3;", "LIMIT"),
        ("static mut COUNTER: u8", "COUNTER"),
        ("pub const fn size()", "size"),
        ("impl Display for Wrapper<T> {", "Wrapper"),
        ("impl<T: Clone + Send> Queue<T> {", "Queue"),
        ("impl<T> Stack {", "Stack"),
        ("export default class Widget extends Base {", "Widget"),
        ("def compute(self):", "compute"),
        ("struct Point;", "Point"),
        ("int main(int argc) {", "main"),
        ("render(props) {", "render"),
        ("if (ready) {", None),
        ("for (;;) {", None),
        ("call(x);", None),
        ("// fn hidden()", None),
        ("# def hidden()", None),
        ("* class hidden", None),
        ("fn x()", None),
        ("", None),
        (None, None),
        ("pub", None),
        ("macro_rules! vec_of {", "vec_of"),
        ("new Thing(a) {", "Thing"),
    ],
)
def test_declared_name(line, name):
    assert decl.declared_name(line) == name


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 1.0, 1.0])], "k int, a array<float>, b array<float>")
    got = df.select("k", vec.dot(F.col("a"), F.col("b")).alias("d"), vec.unit(F.col("a")).alias("u")).orderBy("k").collect()
    assert (got[0]["d"], got[1]["d"]) == (3.0, None) and got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] == [0.0, 0.0]
    mean = vec.normalized_mean(df.groupBy(), F.col("a"), 2).first()["centroid"]
    assert mean == pytest.approx([0.6, 0.8])


def test_embedders(spark):
    table = np.array([[3, 4], [1, 0], [0, 2], [-1, 0]], np.float32)
    assert vec.static_vector([1, 2], table, False).tolist() == [0.5, 1.0]
    assert vec.static_vector([9, -1], table).tolist() == [0, 0] and vec.static_vector([0, 9], table).tolist() == pytest.approx([0.6, 0.8])
    df = spark.createDataFrame([([0],), ([1, 3],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(vec.static_embedder(spark, table)("ids")).collect()][1:] == [[0, 0], [0, 0]]
    v = vec.hash_vector(["refresh", "token"], 64)
    assert np.linalg.norm(v) == pytest.approx(1) and vec.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(ValueError):
        vec.verified_weights(b"abc", 3, "0" * 64)


def test_identity(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    keys = {r[0] for r in df.select(identity.object_key("fp", F.col("x"), F.col("y"))).collect()}
    assert len(keys) == 2  # parts are framed by length
    c = spark.createDataFrame([(["k2", "k1"],), (["k1", "k2"],)], "c array<string>").select(identity.cluster_key("fp", F.col("c"))).collect()
    assert c[0] == c[1] and c[0][0] == identity.cluster_key_of("fp", ["k2", "k1"])
    assert identity.fingerprint({"b": 1, "a": [2]}) == identity.fingerprint({"a": [2], "b": 1})
    with pytest.raises(ValueError):
        identity.digest("other", F.lit("x"))


def test_nfc(spark):
    from lumenix.sources.files import nfc

    assert one(spark, unicodedata.normalize("NFD", "é.txt"), nfc) == "é.txt"


def test_tensors(spark):
    from lumenix.functions import vectors as vec

    df = spark.createDataFrame([(1, [1.0, -2.5, 0.0]), (2, None), (3, [4.0])], "id int, v array<float>")
    for dtype, size in (("f32", 4), ("f16", 2), ("i8", 1)):
        coded = vec.encode_tensors(df, "v", "t", dtype)
        first = coded.where("id = 1").first()["t"]
        assert (first["dtype"], first["shape"], len(first["data"])) == (dtype, [3], 3 * size)
        back = {r["id"]: r["b"] for r in vec.decode_tensors(coded, "t", "b").collect()}
        assert back == {1: [1.0, -2.5 if dtype != "i8" else -2.0, 0.0], 2: None, 3: [4.0]}
        assert vec.decode_tensors(coded, "t", "b", 3).where("b is not null").count() == 1


def test_terms_of_even_texts_are_those_of_their_runs(spark):
    """A text in which one word is to be cut is taken run by run, others whole: terms are the same either way."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbZ09_ -'\n.İıΣσςKÅßÑé́Ⓐⅷ中𐀀𐐀ǅﬁꟋꟜ") for _ in range(rng.randrange(14))) for _ in range(4000)]
    cut = F.lit(" xX")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.terms(F.col("t")).alias("own"), tx.terms(F.concat("t", cut)).alias("cut"))
    assert rows.where(~tx.uneven(F.col("t"))).count() > 500
    assert rows.where(F.concat("own", F.array(F.lit("xx"))) != F.col("cut")).count() == 0


def test_counts_within_rows(spark):
    from collections import Counter

    from lumenix.operators import classify

    rows = [(i, t) for i, t in enumerate([["b", "a", "b", "é", "𐀀", "a", "￿"], [], None, [None, "a", None], *[[f"w{(i * j) % 7}" for j in range(i % 9)] for i in range(1500)]])]
    df = spark.createDataFrame(rows, "i int, terms array<string>")
    got = Counter({(r["i"], r["term"]): r["tf"] for r in tx.counted(df).collect()})
    assert got == Counter((i, t) for i, ts in rows for t in ts or [] if t is not None)
    both = tx.described(df.withColumn("want", classify.frequency_descriptor(F.col("terms"))), "terms", "got")
    assert both.where(~F.col("want").eqNullSafe(F.col("got"))).count() == 0 and both.count() == len(rows)


def test_hashed_rows_equal_one_by_one(spark):
    rows = [(i, t) for i, t in enumerate([["a", "b", "a"], [], None, ["é𐀀"], *[[f"w{(i * j) % 97}" for j in range(i % 40)] for i in range(1200)]])]
    df = spark.createDataFrame(rows, "i int, terms array<string>").repartition(2)
    want = vec.embed_rows(df, "terms", "want", lambda t: vec.hash_vector(t, 16))
    assert vec.hashed_rows(want, "terms", "got", 16).where(~F.col("want").eqNullSafe(F.col("got"))).count() == 0


def test_nfc_holds_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    keys = pa.array([f"{i}" + "xé" * 20_000 for i in range(1000)] + [None, "abc"])
    tracemalloc.start()
    got = files.nfc.func(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[-1].as_py() == "abc" and got[-2].as_py() is None and got[7].as_py() == "7" + "xé" * 20_000
    assert peak < keys.nbytes / 4
