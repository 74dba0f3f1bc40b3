import math

import pytest
from pyspark.sql import functions as F

from sparkrecall.functions import control, redaction, scoring, text
from sparkrecall.operators import bm25


def one(spark, col, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).collect()[0]["x"]


def many(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, q string")
    return [r["x"] for r in df.select("i", f(F.col("q")).alias("x")).orderBy("i").collect()]


def test_sanitize(spark):
    cases = {
        "gpt-4o": "gpt 4o", "a.b:c;d/e?f": "a b c d e f", "café": "café", "日本語": "日本語", "emoji 🎉 test": "emoji   test", "AND OR NOT *(foo)": "foo",
        "NEAR/3 quux": "3 quux", "ANDROID phones": "ANDROID phones", "x" * 600: "x" * 500, "a and b": "a and b",
    }
    assert many(spark, text.sanitize_fts, list(cases)) == list(cases.values())
    assert many(spark, text.sanitize_for_searchable, ["A?b!c:d.E"]) == ["a b c d e"]
    assert many(spark, text.is_alnum, ["abc1", "", "a b", "é"]) == [True, False, False, True]


def test_compile(spark):
    qs = ['"exact phrase"', "'single'", '"', '"a"b"', "alpha beta", "alpha", "gpt-4o", "", "   ", "AND"]
    got = many(spark, text.compile_fts_query, qs)
    assert [(g["match"], g["ok"]) for g in got] == [
        ('"exact phrase"', True), ('"single"', True), ('""', True), ('"a""b"', True), ("alpha OR beta", True), ("alpha*", True), ("gpt OR 4o", True),
        ("", False), ("", False), ("", False),
    ]
    got = many(spark, lambda q: text.compile_fts_query(q, "hybrid"), ["alpha beta", "alpha"])
    assert [g["match"] for g in got] == ["alpha beta", "alpha*"]


def test_routes(spark):
    qs = ["what changed last week", "Project Oxidation status", "cosine simd", "how does the scheduler decide which job runs next", "", "Big Corp today"]
    got = many(spark, lambda q: text.decide_route(text.route_signals(q)), qs)
    assert [g["route"] for g in got] == ["temporal", "entity", "lexical", "semantic", "lexical", "entity"]
    s = many(spark, text.route_signals, ["Recall what I said?", 'the "quoted" thing'])
    assert s[0]["intent"] == "recall" and s[0]["is_question"] and s[1]["has_entity"] and s[1]["intent"] is None


def test_matches(spark):
    docs = ["alpha beta gamma", "alphabet soup", "beta alpha"]
    assert many(spark, lambda t: bm25.matches(t, '"alpha beta"'), docs) == [True, False, False]
    assert many(spark, lambda t: bm25.matches(t, "soup OR gamma"), docs) == [True, True, False]
    assert many(spark, lambda t: bm25.matches(t, "alpha*"), docs) == [True, True, True]
    assert many(spark, lambda t: bm25.matches(t, "alpha beta"), docs) == [True, False, True]


def test_tokens_buckets_logs(spark):
    assert many(spark, text.estimate_tokens, ["a" * 40, "", "数" * 10]) == [42, 2, 12]
    df = spark.createDataFrame([(n,) for n in (0, 64, 65, 257, 1025, 1_000_000)], "n int")
    assert [r[0] for r in df.select(text.length_bucket(F.col("n"))).collect()] == [0, 0, 1, 2, 3, 3]
    assert one(spark, text.format_log(F.lit("e"), F.col("a"), F.lit(None), F.lit(""), k=F.col("b"), z=F.lit(None)), a="x", b=3) == "e | x | k=3"
    assert one(spark, text.sha256_hex(F.col("a")), a="abc").startswith("ba7816bf")


def test_hybrid_and_recency(spark):
    df = spark.createDataFrame([(0.9, 1.0, 100, 0.0, 0.5), (0.5, 4.0, 10, 1.0, 0.0)], "v double, b double, n int, i double, t double")
    got = [r[0] for r in df.select(scoring.hybrid_score(F.col("v"), F.col("b"), F.col("n"), F.col("i"), F.col("t"))).collect()]
    assert got == pytest.approx([0.855, 0.223], abs=1e-9)
    rows = [(0, "2025-01-01"), (1, ""), (2, None), (3, "2026-01-01"), (4, "2025-06-01")]
    df = spark.createDataFrame([("q", i, v) for i, v in rows], "g string, id int, d string")
    bonus = lambda d, b=1.0: [r["bonus"] for r in scoring.recency_bonus(d, "g", "d", "id", b).orderBy("id").collect()]
    assert bonus(df) == [0, 0, 0, 1, 0.5] and bonus(df, 0.0) == [0] * 5
    absurd = spark.createDataFrame([("q", 0, "99999999999999999999999-01-01"), ("q", 1, "2026-01-01"), ("q", 2, "no digits")], "g string, id int, d string")
    assert bonus(absurd) == [1.0, 0.5, 0.0]
    assert bonus(df.filter("id = 0")) == [0]


def test_jaccard(spark):
    df = spark.createDataFrame([("Alex Johnson,", "Alex Johnson"), ("Apple Inc.", "Apple"), ("!!!", "???")], "a string, b string")
    assert [r[0] for r in df.select(scoring.token_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0]


def test_redaction(spark):
    hide = "sk-" + "a" * 24
    rows = [f"key {hide} and gh" + "p_" + "b" * 36 + " mail x@y.org", "plain prose", "AS" + "IA" + "Q" * 16 + " X-Amz-Signature=" + "f" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    every = redaction.RedactionConfig(patterns=tuple(redaction.GROUPS), redact_pii=True)
    got = redaction.scrub(df, "t", every).orderBy("id").collect()
    assert got[0]["match_count"] == 3 and got[0]["groups_fired"] == ["api_keys", "github_tokens", "pii"]
    assert got[0]["content"] == "key [REDACTED:api_keys] and [REDACTED:github_tokens] mail [REDACTED:pii]"
    assert got[1]["content"] == "plain prose" and got[1]["match_count"] == 0 and got[1]["groups_fired"] == []
    assert "ff" not in got[2]["content"] and got[2]["match_count"] == 2
    off = redaction.scrub(df, "t", redaction.RedactionConfig(patterns=("pii",))).collect()
    assert all(r["match_count"] == 0 for r in off)
    assert redaction.scrub(df, "t", redaction.RedactionConfig(enabled=False)).filter("content <> t").count() == 0
    bad = redaction.RedactionConfig(patterns=("nope",), custom_regex=("(secretpattern", "prose"))
    got = redaction.scrub(df, "t", bad).orderBy("id").collect()
    assert got[1]["content"] == "plain [REDACTED:custom_regex]" and len(bad.errors) == 2 and "secretpattern" not in str(bad.errors)


def test_pacing_and_retry(spark):
    table = [(95, 999, "HALTED"), (90, 999, "HALTED"), (75, 999, "THROTTLED"), (10, 0, "HALTED"), (10, 29, "HALTED"), (10, 30, "TAPERED"), (10, 59, "TAPERED"), (10, 60, "CONTINUOUS"),
             (math.nan, 999, "HALTED"), (10, math.nan, "HALTED")]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b, _) in enumerate(table)], "i int, a double, b double")
    got = [r["p"]["mode"] for r in df.select("i", control.decide_pacing(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()]
    assert got == [x[2] for x in table]
    c = control.GovernorConfig
    assert c(5, 10).clamped() == c(10, 20) and c(95, 90).clamped() == c(85, 90) and c(120, 100).clamped() == c(99, 100)
    df = spark.createDataFrame([(1,), (3,), (20,), (0,)], "n int")
    assert [r[0] for r in df.select(control.retry_delay(F.col("n"))).collect()] == pytest.approx([0.1, 0.4, 2.0, 0.1])


def test_breaker(spark):
    b = control.Breaker(2, 10)
    b.record(False, 0, "x")
    assert b.state(0) == "closed" and b.last_error == "x"
    b.record(False, 1)
    assert b.state(1) == "open" and not b.admit(5) and b.admit(11) and not b.admit(12)
    assert b.admit(22)  # a lost probe is admitted again after another cooldown
    b.record(False, 23)
    assert b.state(24) == "open" and b.state(33) == "half_open"
    b.record(True, 34)
    assert b.state(34) == "closed" and b.failures == 0
    calls = spark.createDataFrame([("a", 1, 0.0, False), ("a", 2, 1.0, False), ("a", 3, 2.0, True), ("a", 4, 20.0, True), ("b", 1, 0.0, True)], "key string, seq int, at double, ok boolean")
    got = {(r["key"], r["seq"]): (r["admitted"], r["state"]) for r in control.replay_breaker(calls, 2, 10.0).collect()}
    assert got == {("a", 1): (True, "closed"), ("a", 2): (True, "open"), ("a", 3): (False, "open"), ("a", 4): (True, "closed"), ("b", 1): (True, "closed")}
