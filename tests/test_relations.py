import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.operators import fusion, graph, models, rerank, tokens
from sparkrecall.plans.search import hybrid_search
from sparkrecall.sources import files
from sparkrecall.streaming import doorbell


def ranks(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, id string, score double, source string")


def test_fusion(spark):
    rows = [("shared", 9.0, "fts"), ("f", 1.0, "fts"), ("shared", 0.9, "vector"), ("v", 0.1, "VECTOR")]
    got = {r["id"]: (r["score"], r["source"], r["rank"]) for r in fusion.fused_ranks(ranks(spark, rows), 0.3, 0.7).collect()}
    assert got["shared"] == (0.7, "vector", 1) and len(got) == 3
    tie = fusion.fused_ranks(ranks(spark, [("b", 1.0, "fts"), ("a", 1.0, "fts")])).orderBy("rank").collect()
    assert [r["id"] for r in tie] == ["a", "b"] and {r["score"] for r in tie} == {0.5}
    assert fusion.fuse(ranks(spark, rows), 0.0, 1.0).filter("id = 'f'").collect()[0]["score"] == 0
    assert fusion.fuse(ranks(spark, [])).count() == 0
    with pytest.raises(Exception, match="source"):
        fusion.fuse(ranks(spark, [("a", 1.0, "other")])).collect()


def test_rank_hybrid(spark):
    rows = [("q", 0, 0.9, "same", [1.0, 0.0]), ("q", 1, 0.8, " same ", [1.0, 0.0]), ("q", 2, 0.7, "", [0.0, 1.0]), ("q", 3, 0.6, "", [1.0, 1.0]), ("q", 4, 0.1, "x", [0.5, 1.0])]
    df = spark.createDataFrame(rows, "query_id string, id int, relevance double, content string, v array<double>")
    got = [r["id"] for r in rerank.rank_hybrid(df, 0.7, 10).orderBy("rank").collect()]
    assert got[0] == 0 and sorted(got) == [0, 2, 3, 4]
    guard = spark.createDataFrame([("q", 0, 0, 1.0, True), ("q", 1, 1, 0.9, False)], "query_id string, id int, pos int, score double, is_expansion boolean")
    assert [r["id"] for r in rerank.displacement_guard(guard, 2, 2.0).orderBy("rank").collect()] == [1, 0]


def test_graph(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("b", "e"), ("b", "e"), ("d", "b")]
    g = graph.Graph(spark.createDataFrame([(s, d, "k", 1.0) for s, d in e], "src string, dst string, kind string, weight double"), spark.createDataFrame([("lone",)], "id string"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert g.node_count() == 6 and g.edge_count() == 7
    assert {(r["id"], r["hop"]) for r in g.neighbors_within(ids("a"), 2).collect()} == {("a", 0), ("b", 1), ("e", 1), ("c", 2)}
    assert g.neighbors_within(ids("nope"), 3).count() == 0 and g.neighbors_within(ids("a"), 9, cut=2).count() == 5
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("nope", "nope"), ("lone", "lone")], "src string, dst string")
    assert {(r["src"], r["dst"]): r["path"] for r in g.shortest_path(pairs).collect()} == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"], ("lone", "lone"): ["lone"]}
    seeds = spark.createDataFrame([("a", 0), ("b", 1)], "id string, seed_ord int")
    assert {r["id"] for r in g.expand(seeds, 1, 10).collect()} == {"c", "e"}
    assert g.expand(seeds, 2, 1).count() == 1 and g.expand(seeds, 2, 0).count() == 0


def test_windows_and_packing(spark):
    count = lambda a, b: -(-(b - a) // 4) + 2
    got = tokens.plan_windows(100_000, 7000, 0, count)
    assert got[0] == (0, 27992) and len(got) == 4 and got[-1][1] == 100_000
    assert tokens.plan_windows(0, 10, 0, count) == [(0, 0)] and tokens.plan_windows(5, 100, 3, count) == [(0, 5)]
    assert tokens.plan_windows(4, 10, 0, lambda a, b: 99 * (b - a)) == [(i, i + 1) for i in range(4)]
    over = tokens.plan_windows(1000, 50, 10, count)
    assert all(b[0] < a[1] and count(b[0], a[1]) <= 10 for a, b in zip(over, over[1:]))
    jobs = spark.createDataFrame([(0, i, n) for i, n in enumerate([100, 100, 1, 300, 10, 190, 1])], "bucket int, seq int, tokens int")
    assert [r["batch"] for r in tokens.pack_batches(jobs, 200).orderBy("seq").collect()] == [0, 0, 1, 2, 3, 3, 4]
    w = tokens.token_windows(spark.createDataFrame([(1, "x" * 100, "k")], "id int, t string, extra string"), "t", 42, 0).orderBy("window").collect()
    assert [(r["start"], r["end"]) for r in w] == [(0, 40), (40, 80), (80, 100)] and w[0]["extra"] == "k"


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "word " * 500)], "id int, t string")
    got = {r["id"]: r for r in models.embed(rows, "id", "t", models.HashingBackend(8), max_tokens=1000, batch_tokens=10).collect()}
    assert np.linalg.norm(got[1]["v"]) == pytest.approx(1, abs=1e-6) and got[2]["error"] is None and "2502" in got[3]["error"] and got[3]["v"] is None
    bad = spark.createDataFrame([(1, [0.1], 2, 1, 2)], "id int, scores array<double>, max_spans int, width int, labels int")
    with pytest.raises(Exception, match="shape"):
        models.decode_spans(bad, 0.5).collect()
    assert all(p[-1] == "CPU" for p in models.PROVIDERS.values())


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "skip").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.txt").write_text("x")
    (tmp_path / "sub" / "skip" / "c.txt").write_text("y")
    (tmp_path / "loop").symlink_to(tmp_path / "sub")
    names = lambda df: sorted(r["path"].removeprefix(f"{tmp_path}/") for r in df.filter("error is null").collect())
    assert names(files.fs_walk(spark, str(tmp_path), ("skip",))) == ["a.txt", "sub", "sub/b.txt"]
    assert names(files.fs_walk(spark, str(tmp_path), max_depth=0)) == ["a.txt", "sub"]
    assert files.fs_walk(spark, str(tmp_path), follow=True).filter("error like 'cycle%'").count() == 1
    with pytest.raises(OSError):
        files.fs_walk(spark, str(tmp_path / "none"))
    paths = spark.createDataFrame([(str(tmp_path / "a.txt"),), (str(tmp_path / "no"),)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.hash_files(paths).collect()}
    assert got["a.txt"]["sha256"] == hashlib.sha256(b"hello").hexdigest() and got["no"]["error"] and got["no"]["sha256"] is None
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, sha256 string")
    assert {tuple(r) for r in files.snapshot_diff(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("d", "added")}


SEES = [("bot", "bot", True), ("bot", "bot@1", True), ("bot@1", "bot@1", True), ("bot@1", "bot", False), ("bot@1", "bot@2", False), ("", "", False), ("bot", "bots@1", False),
        ("a@", "a@@x", True), ("a@", "a@x", False), ("a", "a@b@c", True), ("a@b", "a@b@c", False)]


def test_addressing(spark):
    for reader, recipient, want in SEES:
        assert doorbell.sees(reader, recipient) is want, (reader, recipient)
    rings = spark.createDataFrame([(r,) for r in sorted({x[1] for x in SEES})], "recipient string")
    readers = spark.createDataFrame([(r,) for r in sorted({x[0] for x in SEES})], "reader string")
    got = {(r["reader"], r["recipient"]) for r in doorbell.sees_join(rings, readers).collect()}
    assert got == {(a, b) for a in {x[0] for x in SEES} for b in {x[1] for x in SEES} if doorbell.sees(a, b)}


def test_doorbell_replay(spark):
    rings = [(i, 10 + i * 0.002, f"bot@{i % 3}", "o1" if i % 2 else None) for i in range(50)] + [(99, 200.0, "bot@9", "o2"), (100, 300.0, "else", None)]
    rings = spark.createDataFrame(rings, "seq long, at double, recipient string, origin string")
    waits = spark.createDataFrame([(0.0, ["bot"], 5.0), (9.0, ["bot", "bot"], 60.0), (20.0, ["bot"], 5.0), (201.0, ["bot", ""], 5.0), (0.0, [""], 5.0)], "at double, readers array<string>, timeout_s double")
    got = doorbell.replay(rings, waits, window=0.25).orderBy("since").collect()
    assert [r["wake"] for r in got] == ["resync", "mail", "timeout", "mail"]
    assert got[1]["count"] == 50 and got[1]["at"] == pytest.approx(10.25) and got[1]["origins"] == ["o1"] and got[1]["recipients"] == ["bot@0", "bot@1", "bot@2"]
    lost = doorbell.fold([(0, "wait", None, None, 1), (1, "ring", "b", None, None), (500, "ring", "b", None, None), (501, "wait", None, None, 9), (502, "wait", None, None, 1)], 1, 100)[0]
    assert [w["wake"] for _, _, w in lost] == ["resync", "resync", "timeout"]


def test_doorbell_status(spark):
    rings = spark.createDataFrame([(1, 1.0, "a@1"), (2, 2.0, "a@2"), (3, 3.0, "b")], "seq long, at double, recipient string")
    cursors = spark.createDataFrame([("a", 1), ("a\nb", 0), ("z", 0)], "key string, cursor long")
    got = {r["key"]: (r["pending"], r["oldest_pending_s"]) for r in doorbell.status(rings, cursors, 10.0).collect()}
    assert got == {"a": (1, 8.0), "a\nb": (3, 9.0), "z": (0, None)}


def test_doorbell_stream(spark, tmp_path):
    schema = "key string, at double, kind string, recipient string, origin string, timeout double"
    rows = [("a", 0.0, "wait", None, None, 5.0), ("a", 1.0, "ring", "a@1", "o", None), ("a", 1.5, "ring", "a@2", None, None), ("a", 2.0, "wait", None, None, 5.0), ("a", 9.0, "wait", None, None, 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = doorbell.stream(events, window=0.25).writeStream.outputMode("append").format("memory").queryName("bell").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["wake"], r["count"]) for r in spark.table("bell").orderBy("since").collect()]
    assert got[:2] == [("resync", None), ("mail", 2)]


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky")], "id long, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<float>")
    q = docs.join(vec, "id").filter("id = 1")
    got = hybrid_search(docs, vec, q, 3).orderBy("rank").collect()
    assert got[0]["id"] == 1 and len(got) == 3
