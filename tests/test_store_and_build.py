"""Configuration rules, files, the object store, merges, drift, builds and refreshes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenix.operators import classify, retrieve, store
from lumenix.plans import build, config
from lumenix.sources import files, tables
from lumenix.streaming import refresh

GOOD = """
version = 1
[segmenter]
lines = 4
overlap = 1
[dimensions.lexical.classifier]
impl = "structural"
[dimensions.topic.classifier]
impl = "structural"
[dimensions.topic.embedder]
impl = "hash"
[dimensions.topic.fabricator]
impl = "agglomerative"
threshold = 0.3
min_cluster = 2
max_levels = 2
min_remaining = 1
"""


def test_config():
    c = config.parse(GOOD)
    assert (c.lines, c.overlap) == (4, 1) and c.dimensions["topic"].search_levels() == (0, 1, 2) and c.dimensions["lexical"].search_levels() == (0,)
    assert sorted(config.parse("version = 1").active()) == ["declaration", "lexical"]
    described = config.parse(GOOD.replace("[dimensions.lexical.classifier]", '[dimensions.lexical]\ndescription = "words"\n[dimensions.lexical.classifier]'))
    assert described.fingerprint() == c.fingerprint() != config.parse(GOOD.replace("0.3", "0.4")).fingerprint()
    config.check_levels("x", (0, 1, 2), (0, 1))
    with pytest.raises(config.ConfigError):
        config.check_levels("x", (0,), (0, 1))


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("version = 1", "version = 2"),
        ("version = 1", "version = 1\nsurprise = 2"),
        ("lines = 4", "lines = 0"),
        ("overlap = 1", "overlap = 4"),
        ("lines = 4", 'impl = "sentence"\nlines = 4'),
        ("dimensions.lexical", "dimensions.Lexical"),
        ('[dimensions.lexical.classifier]\nimpl = "structural"', "[dimensions.lexical]"),
        ('[dimensions.lexical.classifier]\nimpl = "structural"', '[dimensions.lexical.classifier]\nimpl = "structural"\nprompt = "x"'),
        ("threshold = 0.3", "threshold = 70"),
        ("threshold = 0.3", 'threshold = "0.3"'),
        ("threshold = 0.3", 'label_prompt = "x"'),
        ("min_cluster = 2", "min_cluster = 1"),
        ("min_cluster = 2", "min_cluster = 5\nmax_cluster = 3"),
        ("max_levels = 2", 'max_levels = "3"'),
        ("max_levels = 2", "max_levels = 0"),
        ("max_levels = 2", "max_levels = 65536"),
        ("min_remaining = 1", "min_remaining = 0"),
        ('impl = "agglomerative"', 'impl = "kmeans"'),
        ('[dimensions.topic.embedder]\nimpl = "hash"\n', ""),
        ('[dimensions.topic.classifier]\nimpl = "structural"', '[dimensions.topic.classifier]\nimpl = "structural"\npersist_output = false'),
        ("[dimensions.topic.classifier]", "[dimensions.topic]\ndims = 8\n[dimensions.topic.classifier]"),
        ("[dimensions.topic.classifier]", '[dimensions.topic]\nquant = "binary"\n[dimensions.topic.classifier]'),
        ("version = 1", 'version = 1\n[storage]\ncommit = "none"'),
        ("version = 1", "version = = 1"),
    ],
)
def test_config_is_refused(old, new):
    assert old in GOOD
    with pytest.raises(config.ConfigError):
        config.parse(GOOD.replace(old, new, 1))


def test_disabled_dimensions_still_need_good_names():
    with pytest.raises(config.ConfigError):
        config.parse('version = 1\n[dimensions."../x"]\nenabled = false')


def corpus(root):
    for path, body in {
        "src/session.py": b"def refresh_token(session):\n    return session\n",
        "src/shape.py": b"def bounding_box(points):\r\n    return points\r\n",
        "src/log.py": b"def write_log(line):\n    print(line)\n",
        "build/out.txt": b"ignored token",
        "notes.tmp": b"ignored token",
        "keep.tmp": b"kept words",
        "deep/a/x.dat": b"ignored too",
        "empty.txt": b"",
        "binary.bin": b"a\x00b",
        "latin.txt": b"\xff\xfe\xfd",
        ".hidden": b"hidden but found",
        ".git/config": b"never",
        ".gitignore": b"# comment\nbuild/\n*.tmp\n!keep.tmp\ndeep/**\n",
        "odd name+%41.txt": b"odd words",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return str(root)


def test_discovery(spark, tmp_path):
    root = corpus(tmp_path)
    found = files.discover(spark, root)
    keys = {r["resource"] for r in found.collect()}
    assert keys == {"src/session.py", "src/shape.py", "src/log.py", "keep.tmp", "binary.bin", "latin.txt", ".hidden", ".gitignore", "odd name+%41.txt"}
    texts = {r["resource"]: r["text"] for r in files.contents(found, "o").collect()}
    assert set(texts) == keys - {"binary.bin", "latin.txt"} and "\r" not in texts["src/shape.py"]
    assert files.discover(spark, root, max_bytes=20).where("resource = 'src/log.py'").count() == 0


def test_roots_and_jsonl(spark, tmp_path):
    (tmp_path / "p" / files.INDEX_DIR).mkdir(parents=True)
    (tmp_path / "p" / files.INDEX_DIR / files.CONFIG).write_text("version = 1")
    (tmp_path / "p" / "q").mkdir()
    assert files.find_root(str(tmp_path / "p" / "q")) == str((tmp_path / "p").resolve())
    labels = tables.label_roots(["/a/x", "/b/x", "/c/y", "/a/x"])
    assert set(labels) == {"a/x", "b/x", "y"}
    good = tmp_path / "q.jsonl"
    good.write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": "b"}\n')
    assert files.jsonl(spark, str(good), files.QUERIES).count() == 2
    good.write_text('{"id": "1"}\n\n{bad\n')
    with pytest.raises(ValueError, match="line 3"):
        files.jsonl(spark, str(good), files.QUERIES)


def test_build_find_and_refresh(spark, tmp_path):
    root = corpus(tmp_path)
    first = build.index_folder(spark, root)
    assert first.indexed == 7 and first.skipped == 2 and first.written > 0 and first.reused == 0
    ix = build.open_index(spark, os.path.join(root, files.INDEX_DIR))
    assert ix.find({"lexical": retrieve.Term("refresh token")}).first()["resource"] == "src/session.py"
    assert ix.find({"declaration": retrieve.Term("bounding box")}).first()["resource"] == "src/shape.py"
    assert build.staleness(spark, root).fresh and build.refresh(spark, root) is None
    (tmp_path / "src" / "log.py").write_bytes(b"def write_journal(entry):\n    pass\n")
    (tmp_path / "src" / "new.py").write_bytes(b"def brand_new():\n    pass\n")
    report = build.staleness(spark, root)
    assert (report.added, report.removed) == (1, 0) and report.changed >= 1 and not report.fresh
    again = build.refresh(spark, root)
    assert again.written == 4 and again.reused > 0
    status = store.status(store.load_manifest(spark, os.path.join(root, files.INDEX_DIR, "manifest")), {"lexical": True, "other": True})
    assert status["resources"] == 8 and status["not_built"] == ["other"]


def test_build_with_clusters_and_policies(spark, tmp_path):
    texts = [f"alpha beta gamma {w}" for w in ("one", "two", "three")] + [f"delta epsilon zeta {w}" for w in ("four", "five", "six")]
    contents = spark.createDataFrame([("o", f"r{i}", t) for i, t in enumerate(texts)], "origin string, resource string, text string")
    c = config.parse(GOOD)
    stats = build.build(spark, contents, str(tmp_path / "ix"), c)
    assert stats.clusters >= 2
    ix = build.open_index(spark, str(tmp_path / "ix"), config=c)
    assert 1 in ix.dimensions["topic"].levels
    top = ix.find_at({"topic": retrieve.Term("alpha beta gamma")}, 1, retrieve.parse_levels("clusters")).first()
    assert top["level"] >= 1 and top["score"] > 0.5
    broken = config.parse(GOOD.replace('impl = "hash"', 'impl = "absent"'))
    with pytest.raises(RuntimeError):
        build.build(spark, contents, str(tmp_path / "b"), broken)
    left = build.build(spark, contents, str(tmp_path / "b"), broken, policy=store.Degraded.ALLOW)
    assert left.left_out == ["topic"] and not os.path.exists(tmp_path / "b" / "snapshot")
    assert store.decide(store.Degraded.ASK, ["x"], lambda m: True) == ["x"]


LLM = """
version = 1
[dimensions.lexical.classifier]
impl = "structural"
[dimensions.purpose.classifier]
impl = "llm"
[dimensions.subject.classifier]
impl = "llm"
"""


def test_models_are_asked_once_for_each_input(spark, tmp_path):
    """Two dimensions share a call; a second build, a restored cache and a copy of a text ask nothing."""
    log = str(tmp_path / "calls")

    def make():
        stub = classify.stub_client()

        def client(system, user, schema):
            with open(log, "a") as f:
                f.write(f"{user.count('--- Segment')}\n")
            return stub(system, user, schema)

        return classify.ChatClassifier(client)

    calls = lambda: open(log).read().split() if os.path.exists(log) else []
    texts = [f"alpha beta gamma {w} " * 3 for w in ("one", "two", "three", "four", "five")]
    rows = [("o", f"r{i}", t) for i, t in enumerate(texts)]
    of = lambda r: spark.createDataFrame(r, "origin string, resource string, text string")
    out, stages, c = str(tmp_path / "ix"), build.Stages(llm=make), config.parse(LLM)
    first = build.build(spark, of(rows), out, c, stages)
    assert calls() == ["1"] * 5 and (first.written, first.reused) == (15, 0)
    again = build.build(spark, of(rows), out, c, stages)
    assert len(calls()) == 5 and (again.written, again.reused) == (0, 15)
    third = build.build(spark, of([*rows, ("o", "copy", texts[0]), ("o", "new", "delta epsilon")]), out, c, stages)
    assert len(calls()) == 6 and (third.written, third.reused) == (3, 15)
    find = lambda: [tuple(r) for r in build.open_index(spark, out, stages).find({"purpose": retrieve.Term("three alpha"), "subject": retrieve.Term("three")}, 20).select("resource", "score").collect()]
    found = find()
    assert found[0][0] == "r2"
    head = json.loads((tmp_path / "ix" / "config.json").read_text())
    (tmp_path / "ix" / "config.json").write_text(json.dumps(head | {"manifest": "another"}))
    assert build.staleness(spark, str(tmp_path), out).index_replaced
    assert find() == found and json.loads((tmp_path / "ix" / "config.json").read_text())["cache"] != head["cache"] and len(calls()) == 6
    assert not build.staleness(spark, str(tmp_path), out).index_replaced


def test_tampered_objects_are_refused(spark, tmp_path):
    contents = spark.createDataFrame([("o", "r", "alpha beta")], "origin string, resource string, text string")
    out = str(tmp_path / "ix")
    build.build(spark, contents, out, config.default())
    good = store.read(spark, f"{out}/objects").collect()
    spark.createDataFrame([r.asDict() | {"payload": "[]"} for r in good], "object_key string, content_hash string, len long, tier string, payload string").write.mode("overwrite").parquet(f"{out}/objects")
    with pytest.raises(store.Tampered):
        build.open_index(spark, out)
    with pytest.raises(store.Tampered):
        build.build(spark, contents, out, config.default())


def test_stages_can_be_replaced(spark, tmp_path):
    contents = spark.createDataFrame([("o", "r", "alpha beta"), ("o", "s", "beta\ngamma")], "origin string, resource string, text string")

    def shout(segments, names):
        return segments.select("origin", "resource", "start", "end", F.lit(0).alias("level"), F.lit(names[0]).alias("dimension"), F.array(F.upper("text")).alias("terms"))

    seen = []
    stages = build.Stages(
        classifiers={"shout": shout}, segmenter=lambda c, lines, overlap: build.windows(c, 1, 0), progress=lambda step, name, n: seen.append((step, n)),
        scorers={"loud": lambda df, text: df.where(F.array_contains("terms", text)).select("origin", "resource", "start", "end", "level", F.lit(0.5).alias("score"))},
    )
    c = config.Config(dimensions={"loud": config.DimensionConfig(classifier=config.Stage("shout"))})
    out = str(tmp_path / "ix")
    assert build.build(spark, contents, out, c, stages).segments == 3
    assert ("segments", 3) in seen and ("objects", 2) in seen
    assert [(r["resource"], r["score"]) for r in build.open_index(spark, out, stages).find({"loud": retrieve.Term("GAMMA")}).collect()] == [("s", 0.5)]
    m = store.load_manifest(spark, f"{out}/manifest")
    assert store.brief(store.status(m, {"loud": True, "x": True})) == "2 resources, 2 objects\ndimensions: loud (levels 0)\nconfigured but not built: x\nadvice: build the missing dimensions"
    book = str(tmp_path / "ledger" / "l")
    assert store.ledger(spark, book, m) and not store.ledger(spark, book, m) and len(open(book).readlines()) == 1


def objects(spark, rows):
    df = spark.createDataFrame(rows, "k string, body string")
    return store.as_objects(df, F.col("k"), F.col("body"))


def test_objects_are_immutable(spark, tmp_path):
    path = str(tmp_path / "objects")
    assert store.put(path, objects(spark, [("a", "1"), ("b", "2")])) == 2
    assert store.put(path, objects(spark, [("a", "1"), ("c", "3")])) == 1
    with pytest.raises(store.KeyCollision):
        store.put(path, objects(spark, [("a", "other")]))
    have = store.read(spark, path)
    store.verify(have, have)
    with pytest.raises(store.Tampered):
        store.verify(have.withColumn("payload", F.lit("x")), have)
    keep = manifest(spark, [("a", "1")], {}, {})
    assert store.gc_report(have, [keep]).first()["objects"] == 2
    assert store.prune(path, [keep]) == 2 and {r["object_key"] for r in store.read(spark, path).collect()} == {"a"}
    with pytest.raises(ValueError):
        store.unreachable(have, [])


def manifest(spark, objs, roots, trees, fp="fp", dims=(("d", "i", [0, 1]),), at=0):
    return store.Manifest(
        fp,
        objects(spark, objs).drop("payload"),
        spark.createDataFrame(list(dims), store.SCHEMAS["dimensions"]),
        spark.createDataFrame(list(roots.items()), store.SCHEMAS["roots"]) if roots else spark.createDataFrame([], store.SCHEMAS["roots"]),
        spark.createDataFrame(list(trees.items()), store.SCHEMAS["clusters"]) if trees else spark.createDataFrame([], store.SCHEMAS["clusters"]),
        provenance={"generated_at": at},
    )


def test_merge(spark):
    base = manifest(spark, [("a", "1"), ("b", "2")], {"x": '["a"]', "y": '["b"]', "z": '["b"]'}, {"d": ["c0"]})
    ours = manifest(spark, [("a", "1"), ("b", "2"), ("n", "5"), ("c1", "t")], {"x": '["a"]', "y": '["n"]', "z": '["n"]'}, {"d": ["c1"]}, at=1)
    theirs = manifest(spark, [("a", "1"), ("m", "6"), ("c2", "u")], {"y": '["m"]', "w": '["m"]'}, {"d": ["c2"]}, at=2)
    out = store.merge(base, ours, theirs)
    assert {r["resource"]: r["entry"] for r in out.manifest.roots.collect()} == {"y": '["n"]', "z": '["n"]', "w": '["m"]'}
    assert out.stale == ["y", "z"] and len(out.notes) == 1 and out.manifest.clusters.count() == 0
    assert out.manifest.dimensions.first()["levels"] == [0] and out.manifest.provenance == {"generated_at": 2}
    assert {r["object_key"] for r in out.manifest.objects.collect()} == {"n", "m", "c1", "c2"}
    clash = manifest(spark, [("a", "9")], {}, {}, fp="fp3", dims=(("d", "k", [0]),))
    with pytest.raises(store.MergeConflict) as e:
        store.merge(base, manifest(spark, [("a", "1")], {}, {}, fp="fp2", dims=(("d", "j", [0]),)), clash)
    assert {k for k, _ in e.value.conflicts} == {"config_fingerprint", "dimension", "object"}
    named = manifest(spark, [("n", "5"), ("c1", "t")], {"y": '["n"]'}, {"d": ["c1"]})
    assert store.merge(None, named, named).manifest.same_content(named)


def test_manifest_files(spark, tmp_path):
    m = manifest(spark, [("a", "1")], {"x": '["a"]'}, {"d": ["c0"]})
    path = str(tmp_path / "m")
    assert store.save_manifest(m, path) and not store.save_manifest(m, path)
    assert store.load_manifest(spark, path).same_content(m)
    head = tmp_path / "m" / "head.json"
    body = head.read_text()
    head.write_text("<<<<<<< ours\n" + body)
    with pytest.raises(ValueError):
        store.load_manifest(spark, path)
    head.write_text(body.replace('"format_version": 2', '"format_version": 9'))
    with pytest.raises(ValueError):
        store.load_manifest(spark, path)


def test_stream_adds_objects_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "doc_id long, text string").write.parquet(src)
    run = lambda: refresh.refresh_stream(spark, src, "doc_id long, text string", lambda b: b.select("text"), str(tmp_path / "objects"), str(tmp_path / "cp"), "fp").awaitTermination()
    run()
    assert store.read(spark, str(tmp_path / "objects")).count() == 2
    spark.createDataFrame([(4, "gamma"), (5, "delta")], "doc_id long, text string").write.mode("append").parquet(src)
    run()
    assert store.read(spark, str(tmp_path / "objects")).count() == 3


def test_putting_and_verifying_leaves_payloads_in_place(spark, tmp_path):
    """Only keys, hashes and lengths are shuffled; a key that comes twice is still written once."""

    def shuffled() -> int:
        c = spark.sparkContext
        c._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = c._jsc.sc().statusStore().stageList(None, False, False, c._gateway.new_array(c._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    path = str(tmp_path / "objects")
    rows = [(f"k{i}", os.urandom(20_000).hex()) for i in range(100)]
    fresh = store.as_objects(spark.createDataFrame(rows, "k string, p string"), F.col("k"), F.col("p"))
    more = store.as_objects(spark.createDataFrame([("other", "x" * 40_000)], "k string, p string"), F.col("k"), F.col("p"))
    before = shuffled()
    assert store.put(path, fresh) == 100 and store.put(path, more) == 1
    store.verify(store.read(spark, path), fresh.drop("payload"))
    assert shuffled() - before < 400_000
    twice = store.as_objects(spark.createDataFrame([("k1", rows[1][1]), ("new", "y"), ("new", "y")], "k string, p string"), F.col("k"), F.col("p"))
    assert store.put(path, twice) == 1 and store.read(spark, path).count() == 102
