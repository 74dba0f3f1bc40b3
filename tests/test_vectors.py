import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkrecall.functions import vectors as V
from sparkrecall.operators.rerank import displacement_order, mmr_order
from sparkrecall.operators.search import max_pool, top_k
from sparkrecall.operators.vector_index import VectorIndex


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<float>")


def test_cosine_and_dimension_error(spark):
    df = spark.createDataFrame([([2.0, 0.0], [3.0, 0.0]), ([2.0, 0.0], [0.0, 5.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimensions"):
        bad.select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_blob_round_trip_at_many_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=n).astype("f4").tolist()) for n in (1, 7, 8, 9, 16, 100, 1024)]
    df = frame(spark, rows).withColumn("b", V.f32_as_blob("v"))
    for r in df.select("id", "v", "b", V.blob_as_f32("b").alias("w")).collect():
        assert r["v"] == r["w"] and len(r["b"]) == 4 * r["id"]
    cut = df.select(V.blob_as_f32(F.expr("substring(b, 1, octet_length(b) - 1)")).alias("w"), "id").collect()
    assert all(len(r["w"]) == r["id"] - 1 for r in cut)


def test_max_pool(spark):
    anchors = frame(spark, [(0, [0, 1, 0, 0]), (1, [1, 0, 0, 0])])
    cands = frame(spark, [(0, [1, 0, 0, 0]), (1, [0, 1, 0, 0]), (2, [0.5, 0.5, 0, 0])])
    got = {r["id"]: r["score"] for r in max_pool(cands, anchors).collect()}
    assert got[0] == got[1] == 1 and abs(got[2] - 0.7071) < 1e-4
    assert {r["score"] for r in max_pool(cands, anchors.limit(0)).collect()} == {-1.0}
    assert max_pool(cands, anchors, block=1).filter("id = 2").collect()[0]["score"] == pytest.approx(got[2])


def test_int8_index_recall_and_error(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(2000, 64)).astype("f4")
    df = frame(spark, list(enumerate(m.tolist())))
    q = df.filter("id < 20")
    index = VectorIndex(64).upsert(df)
    approx, exact = index.search(q, 50).collect(), top_k(df, q, 10).collect()
    near = {(r["query_id"], r["id"]) for r in approx}
    assert sum((r["query_id"], r["id"]) in near for r in exact) >= 195
    true = {(r["query_id"], r["id"]): r["score"] for r in top_k(df, q, 2000).collect()}
    assert max(abs(r["score"] - true[r["query_id"], r["id"]]) for r in approx) < 0.02
    two = {(r["query_id"], r["id"], r["rank"]) for r in index.two_stage(df, q, 10, 50).collect()}
    assert len(two & {(r["query_id"], r["id"], r["rank"]) for r in exact}) >= 195


def test_index_changes(spark):
    df = frame(spark, [(i, [1 + i, 2, 3]) for i in range(50)])
    index = VectorIndex(3).upsert(df).upsert(frame(spark, [(7, [-1, 0, 0])]))
    assert index.count() == 50 and index.nbytes() == 50 * 7 and index.contains(7)
    index, gone = index.remove(frame(spark, [(0, [0, 0, 0]), (999, [0, 0, 0])]))
    assert gone.collect()[0][0] == 1 and index.count() == 49 and not index.contains(0)
    q = frame(spark, [(1, [1, 0, 0])])
    hits = index.search(q, 10, frame(spark, [(3, [0]), (4, [0]), (5, [0]), (999, [0])])).collect()
    assert {r["id"] for r in hits} == {3, 4, 5}
    assert index.search(q, 0).count() == 0 and index.search(frame(spark, [(1, [0, 0, 0])]), 5).count() == 0
    for bad in ([float("nan"), 0, 0], [1, 2], [float("inf"), 0, 0]):
        with pytest.raises(ValueError):
            index.upsert(frame(spark, [(1, [1, 2, 3]), (2, bad)]))
    with pytest.raises(ValueError):
        VectorIndex(0)


def test_quantised_zero_vector(spark):
    r = frame(spark, [(1, [0, 0])]).select(V.quantize_int8(F.col("v")).alias("q")).collect()[0]["q"]
    assert list(r["codes"]) == [0, 0] and r["scale"] == 0


def test_blocks_of_queries_agree(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, list(enumerate(rng.normal(size=(200, 8)).tolist())))
    a = sorted(map(tuple, top_k(df, df.filter("id < 30"), 5).collect()))
    b = sorted(map(tuple, top_k(df, df.filter("id < 30"), 5, block=7).collect()))
    assert [(x[0], x[1], x[3]) for x in a] == [(x[0], x[1], x[3]) for x in b]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 15), st.integers(0, 10_000), st.booleans())
def test_mmr_picks_are_unique(n, k, seed, swap):
    rng = np.random.default_rng(seed)
    got = mmr_order(rng.normal(size=n), rng.normal(size=(n, 3)), 0.7, k, swap=swap)
    assert len(got) == len(set(got)) == min(n, k)


def test_mmr_cases():
    eye = np.eye(3)
    assert mmr_order(np.array([0.5, 0.9, 0.1]), eye, 0.7, 3, seed_first=True)[0] == 0
    assert mmr_order(np.array([0.5, 0.9]), np.eye(2), 0.7, 2) == [1, 0]
    for n in (50, 200):
        rel = np.linspace(1, 0, n)
        rel[3] = np.nan
        assert mmr_order(rel, np.eye(n), 0.7, n)[-1] == 3
    # equal scores: after swap-removal of the first, the last stands in its place
    assert mmr_order(np.zeros(4), np.eye(4), 1.0, 4, swap=True) == [0, 3, 2, 1]
    assert mmr_order(np.zeros(4), np.eye(4), 1.0, 4) == [0, 1, 2, 3]


def test_displacement_cases():
    assert displacement_order([1.0, 0.9], [True, False], 2, 2) == [1, 0]
    assert displacement_order([3.0, 1.0], [True, False], 2, 2) == [0, 1]
    assert displacement_order([-1.0, -2.0], [True, False], 2, 2) == [1, 0]
    for protected, margin in ((0, 2), (2, 1), (2, 0.5)):
        assert displacement_order([1.0, 0.9], [True, False], protected, margin) == [0, 1]
    assert displacement_order([1.0, 0.9], [True, True], 2, 2) == [0, 1] and displacement_order([], [], 3, 2) == []
    rnd = random.Random(1)
    order = displacement_order([rnd.random() for _ in range(20)], [rnd.random() < 0.5 for _ in range(20)], 10, 2)
    assert sorted(order) == list(range(20))
