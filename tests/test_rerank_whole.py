import numpy as np
import pytest

from sparkrecall.operators import rerank

CANDS = "query_id string, id long, relevance double, v array<double>"


def test_displacement_keeps_and_weighs_rows_after_the_thousandth(spark):
    scores = [1 - i * 1e-4 for i in range(1500)]
    expansion = [i < 1200 or bool(i % 2) for i in range(1500)]
    rows = [("q", 10_000 + i, i, s, e) for i, (s, e) in enumerate(zip(scores, expansion))] + [("p", 1, 0, 1.0, True)]
    df = spark.createDataFrame(rows, "query_id string, id long, pos int, score double, is_expansion boolean")
    got = {(r["query_id"], r["id"]): r["rank"] for r in rerank.displacement_guard(df, 10, 1.2).collect()}
    want = {("q", 10_000 + i): n + 1 for n, i in enumerate(rerank.displacement_order(scores, expansion, 10, 1.2))}
    assert got == want | {("p", 1): 1} and any(got["q", 10_000 + i] != i + 1 for i in range(10))


def test_mmr_weighs_every_candidate(spark):
    rows = [("q", i, 1.0 - i * 1e-4, [1.0, 0.0]) for i in range(1200)] + [("q", 5000, 0.5, [0.0, 1.0]), ("p", 7, 0.1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, CANDS).repartition(5)
    for got in (rerank.mmr_scored(df, 0.5, 2, seed_first=True), rerank.mmr_query(df, 0.5, 2)):
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == {("q", 0, 1), ("q", 5000, 2), ("p", 7, 1)}


@pytest.mark.parametrize("swap", [False, True])
def test_passes_match_the_fold(spark, monkeypatch, swap):
    monkeypatch.setattr(rerank, "FOLD", 20)
    rnd = np.random.default_rng(5)
    # few values, so that most picks are ties and positions count
    rows = [(q, int(i), float(rnd.integers(0, 3)) if rnd.random() < 0.95 else float("nan"), rnd.integers(0, 2, 2).astype(float).tolist()) for q in "ab" for i in rnd.permutation(60)]
    df = spark.createDataFrame(rows, CANDS).repartition(3)
    out = rerank.mmr_query(df, 0.6, 25) if swap else rerank.mmr_scored(df, 0.6, 25, seed_first=True)
    for q in "ab":
        # NaN is the greatest in Spark's order
        own = sorted((r for r in rows if r[0] == q), key=lambda r: r[1] if swap else (r[2] == r[2], -r[2] if r[2] == r[2] else 0, r[1]))
        order = rerank.mmr_order(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 0.6, 25, not swap, swap)
        got = [r["id"] for r in out.filter(f"query_id = '{q}'").orderBy("rank").collect()]
        assert got == [own[i][1] for i in order]
