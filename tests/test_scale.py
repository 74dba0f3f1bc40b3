import random
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.functions import redaction
from sparkrecall.operators import bm25, graph, models, search
from sparkrecall.operators.best import Best
from sparkrecall.plans.search import hybrid_search
from sparkrecall.streaming import doorbell


def shuffled(df):
    """Rows that the plan of ``df`` has sent through its exchanges."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            kids = node.children()
            left += [kids.apply(i) for i in range(kids.length())]
    return found


def test_best_keeps_what_a_sort_keeps():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 6, (5, 400)).astype(float)
    s[4] = np.nan
    best = Best(5, 7)
    best.room = 40
    order = rng.permutation(400)
    for at in range(0, 400, 13):
        best.add(s[:, order[at : at + 13]], order[at : at + 13])
    got = [tuple(x.values()) for b in best.rows(np.arange(5)) for x in b.to_pylist()]
    want = [(q, int(i), s[q, i]) for q in range(4) for i in np.lexsort((np.arange(400), -s[q]))[:7]]
    assert got == want


def test_bm25_agrees_with_sums_over_postings_and_shuffles_few_rows(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(300)], k=rnd.randrange(0, 40))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, texts[0])], "id long, text string").repartition(6)
    asks = docs.filter("id % 50 = 0")
    doc = docs.select("id", bm25.tokens(F.col("text")).alias("ts"))
    n, avgdl = doc.agg(F.count("*"), F.avg(F.size("ts"))).collect()[0]
    tf = doc.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("t")).groupBy("id", "dl", "t").agg(F.count("*").alias("tf"))
    w = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / avgdl))
    pairs = doc.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.explode(F.array_distinct("ts")).alias("t")).join(tf, "t").join(tf.groupBy("t").agg(F.count("*").alias("df")), "t")
    brute = pairs.groupBy("query_id", "id").agg(F.round(F.sum(w), 9).alias("s")).toPandas().sort_values(["query_id", "s", "id"], ascending=[True, False, True])
    want = [(r.query_id, r.id, pytest.approx(r.s, abs=2e-9)) for r in brute.groupby("query_id").head(20).itertuples()]
    for options in ({}, {"block": 7}, {"terms_at_once": 60}):
        out = bm25.bm25_top_k(docs, asks, 20, **options)
        assert [(r["query_id"], r["id"], r["score"]) for r in out.orderBy("query_id", "rank").collect()] == want
    assert shuffled(bm25.bm25_top_k(docs, asks, 2)) < len(brute) / 5


def test_hybrid_search_moves_no_texts(spark):
    docs = spark.createDataFrame([(i, f" red apple {i % 3} pie ") for i in range(8)] + [(8, " "), (9, "")], "id long, text string")
    vec = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "id long, v array<float>")
    got = [r["id"] for r in hybrid_search(docs, vec, docs.join(vec, "id").filter("id = 1"), 10).orderBy("rank").collect()]
    assert got[0] == 1 and len(got) == 5 and {8, 9} < set(got)


def test_search_holds_few_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], "id long, v array<float>").repartition(3)
    q = v.filter("id % 3 = 0")
    m = {r["id"]: np.array(r["v"]) / np.linalg.norm(r["v"]) for r in v.collect()}
    out = search.top_k(v, q, 3, block=40)
    best = {i: sorted(m, key=lambda j: (-round(float(m[i] @ m[j]), 12), j))[:3] for i in range(0, 600, 3)}
    assert {(r["query_id"], r["rank"]): r["id"] for r in out.collect()} == {(i, n): j for i, js in best.items() for n, j in enumerate(js, 1)}
    pool = search.max_pool(v, q, block=9)
    assert str(pool._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    assert {r["id"]: r["score"] for r in pool.collect()} == pytest.approx({i: max(float(x @ m[j]) for j in range(0, 600, 3)) for i, x in m.items()})


def bfs(edges, start, max_hops=99):
    """id -> smallest of the shortest paths from ``start``."""
    out, front = {start: [start]}, {start: [start]}
    for _ in range(max_hops):
        step = {}
        for at, path in front.items():
            for s, d in edges:
                if s == at and d not in out:
                    step[d] = min(step.get(d, path + [d]), path + [d])
        out |= step
        front = step
    return out


@pytest.mark.parametrize("small", [0, 100_000])
def test_walks_in_classes_agree_with_walks_of_each_start(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rnd = random.Random(6)
    # cycles, parallels, starts that share their only neighbour, one that leads back to itself
    edges = [(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for _ in range(22)] + [(f"s{i}", f"n{i % 2}") for i in range(6)] + [("n0", "s2"), ("s7", "s7"), ("s2", "n0")]
    nodes = {x for e in edges for x in e} | {"lone"}
    g = graph.Graph(spark.createDataFrame([(s, d, "k", 1.0) for s, d in edges], "src string, dst string, kind string, weight double"), spark.createDataFrame([("lone",)], "id string"))
    starts = [f"s{i}" for i in range(8)] + ["n3", "n0", "lone", "nope", "n3"]
    for hops in (0, 1, 3):
        got = g.neighbors_within(spark.createDataFrame([(s,) for s in starts], "id string"), hops, cut=2).collect()
        want = {(s, x, len(p) - 1) for s in set(starts) & nodes for x, p in bfs(edges, s, hops).items()}
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    pairs = [(s, d) for s in starts for d in sorted(nodes)]
    for hops in (None, 2):
        got = g.shortest_path(spark.createDataFrame(pairs, "src string, dst string"), hops).collect()
        want = {(s, x): p for s in set(starts) & nodes for x, p in bfs(edges, s, 99 if hops is None else hops).items()}
        assert len(got) == len(want) and {(r["src"], r["dst"]): r["path"] for r in got} == want
    seeds = [("s3", 4), ("s1", 2), ("s5", 9), ("n3", 1)]
    best = {}
    for s, o in seeds:
        for x, p in bfs(edges, s, 2).items():
            if x not in {s for s, _ in seeds}:
                best[x] = min(best.get(x, (o, len(p) - 1)), (o, len(p) - 1))
    got = [tuple(r) for r in g.expand(spark.createDataFrame(seeds, "id string, seed_ord int"), 2, 9).collect()]
    assert got == [(x, *b) for b, x in sorted((b, x) for x, b in best.items())][:9]


def test_starts_with_one_neighbour_shuffle_no_walk_of_their_own(spark):
    edges = [(f"s{i}", "hub") for i in range(200)] + [("hub", f"c{i}") for i in range(100)]
    g = graph.Graph(spark.createDataFrame([(s, d, "k", 1.0) for s, d in edges], "src string, dst string, kind string, weight double"))
    out = g.neighbors_within(spark.createDataFrame([(f"s{i}",) for i in range(200)], "id string"), 2)
    assert shuffled(out) < 2000 and out.count() == 200 * 102


def test_wakes_hold_no_group_and_trim_in_one_pass(spark):
    rings = spark.range(30_000).selectExpr("id as seq", "cast(id as double) as at", "concat('bot@', id % 7) as recipient", "cast(null as string) as origin")
    waits = spark.range(9).selectExpr("id * 3600.0D - 1 as at", "array('bot') as readers", "7200.0D as timeout_s").unionByName(spark.range(9).selectExpr("id * 3600.0D - 1 as at", "array('bot@3') as readers", "60.0D as timeout_s"))
    out = doorbell.replay(rings, waits, window=60.0, keep=86400.0)
    assert "FlatMapGroups" not in str(out._jdf.queryExecution().executedPlan())
    got = {(r["key"], r["since"], r["at"]): (r["wake"], r["count"]) for r in out.collect()}
    for key, deadline in (("bot", 7200.0), ("bot@3", 60.0)):
        events = sorted([(float(i), "ring", "bot@3", None, None) for i in range(30_000) if key == "bot" or i % 7 == 3] + [(i * 3600.0 - 1, "wait", None, None, deadline) for i in range(9)])
        want = {(key, a, b): (w["wake"], w.get("count")) for a, b, w in doorbell.fold(events, 60.0, 86400.0)[0]}
        assert want == {k: v for k, v in got.items() if k[0] == key} and len(want) == 9
    began = time.process_time()
    lost = doorbell.fold([(0.0, "wait", None, None, 1.0)] + [(i / 10, "ring", "b", None, None) for i in range(60_000)] + [(7000.0, "wait", None, None, 1.0)], 1, 1000)[1]
    assert not lost.pending and time.process_time() - began < 5


def test_embedding_holds_a_bounded_part_of_a_batch(spark, tmp_path, monkeypatch):
    text = "A" * 100 + " Ünï  İx\n" + "word " * 40_000 + "z" * 70_000 + " end"
    whole = np.zeros(16, dtype=np.float32)
    for w in text.lower().split():
        h = crc32(w.encode())
        whole[h % 16] += 1 if h & 0x8000_0000 else -1
    assert np.allclose(models.HashingBackend(16).run([text, ""]), [whole / np.linalg.norm(whole), np.zeros(16)])
    assert [len(x) < 20_000 for x in models._words(text)] == [True] * len(list(models._words(text))) and len(list(models._words(text))) > 2

    class Counting(models.HashingBackend):
        def run(self, texts):
            assert sum(map(len, texts)) <= 1 << 20
            return np.full((len(texts), 2), len(texts), dtype=np.float32)

    # short texts that one batch of the backend could hold, but not one part
    rows = spark.range(2000).selectExpr("id", "if(id % 100 = 3, null, repeat('ab ', 1000)) as t").coalesce(1)
    got = models.embed(rows, "id", "t", Counting(), batch_tokens=10**9)
    assert "MapInArrow" in str(got._jdf.queryExecution().executedPlan())
    got = got.collect()
    assert len(got) == 2000 and [r["id"] for r in got] == list(range(2000)) and max(r["v"][0] for r in got) < 400


def test_texts_without_a_part_of_a_match_are_not_searched(spark):
    fill = "Ab1" * 20
    hits = [f"x sk-ant-{fill} sk-proj-{fill}, sk-{fill[:30]} xai-{fill} AIza{fill[:35]}", f"AUTHORIZATıON: Bearer {fill} and BEARER {fill}", f"eyJ{fill}.eyJ{fill}.{fill}", f"AKIA{'Q7' * 8} ASIA{'Q7' * 8}",
            f"AWS_ſecret_Acceſs_Key = {fill[:40]}", f"X-Amz-Security-ToKen={fill} awſSeſſionToKen {fill} X-AMZ-ſİGNATURE={fill[:20]} ſıgnature={fill[:20]}",
            " ".join(f"gh{c}_{fill[:36]}" for c in "pousr"), "a.b@c.de (212) 555-0123 and 123-45-6789", "sk- gh_ bearer none - @ 12", "", None]
    df = spark.createDataFrame(list(enumerate(hits)), "id int, text string")
    config = redaction.RedactionConfig(patterns=tuple(redaction.GROUPS), redact_pii=True)
    out = redaction.scrub(df, "text", config)
    want, n = df.withColumn("content", F.col("text")), F.lit(0)
    for group in redaction.ORDER:
        for p in redaction.GROUPS.get(group, ()):
            want = want.withColumn("n" + str(len(want.columns)), F.coalesce(F.regexp_count("content", F.lit(p)), F.lit(0))).withColumn("content", F.regexp_replace("content", F.lit(p), F.lit(f"[REDACTED:{group}]")))
    total = sum((F.col(c) for c in want.columns[3:]), F.lit(0))
    assert out.select("id", "content", "match_count").collect() == want.select("id", "content", total.alias("match_count")).collect()
    assert all(want.agg(*[F.sum(c) for c in want.columns[3:]]).collect()[0]), "every pattern has a case"
    assert set(redaction.PARTS) == {p for ps in redaction.GROUPS.values() for p in ps}
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Contains(") >= 17
