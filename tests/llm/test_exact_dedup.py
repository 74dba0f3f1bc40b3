import hashlib
import re

from sparkrecall.llm.exact_dedup import DigestIndex, exact_dedup, kept_documents


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for sha, g in groups.items():
        best = min(g)
        out += [(x[4], best[4], len(g), x is best, sha) for x in g]
    return sorted(out, key=str)


def test_against_brute_force(spark, docs_of):
    texts = ["a b", "ab", " a\tb \n", None, "", "  ", "é x", "éx", "long " * 50_000, "long" * 50_000, "ab", "a b", "ab"]
    ids = [3, 1, 2, 9, 8, 7, 5, 4, 11, 10, 1, 6, None]
    got = exact_dedup(docs_of(texts, ids=ids)).drop("row_no").collect()
    assert sorted(map(tuple, got), key=str) == brute(list(zip(ids, texts)))
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_empty_and_clashing_columns(spark, docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    df = docs_of(["x y", "xy"]).selectExpr("*", "1 as keep_id", "2 as text_sha256", "3 as row_no")
    assert {(r["doc_id"], r["kept"]) for r in exact_dedup(df).collect()} == {(0, True), (1, False)}
    assert [r["doc_id"] for r in kept_documents(docs_of(["x y", "xy", "z"])).orderBy("doc_id").collect()] == [0, 2]


def test_index_persists_between_batches(spark, docs_of):
    index = DigestIndex(spark)
    exact_dedup(docs_of(["one", "two", "two "]), index).count()
    got = {r["doc_id"]: r for r in exact_dedup(docs_of(["t wo", "three"], ids=[50, 51]), index).collect()}
    assert not got[50]["kept"] and got[50]["keep_id"] == 2 and got[51]["kept"]
    assert index.rows().count() == 3
    index.drop()


def test_a_batch_may_come_again(spark, docs_of):
    """As after a crash: nothing is lost, nothing is counted twice."""
    index = DigestIndex(spark, "retry", buckets=3)
    first = docs_of(["one", "t w o", "two", "a longer text", "a longer  text"])
    want = sorted((r["doc_id"], r["text"]) for r in kept_documents(first, index).collect())
    assert [i for i, _ in want] == [0, 1, 4]
    before = sorted(map(tuple, index.rows().select("text_sha256", "keep_id").collect()))
    assert sorted((r["doc_id"], r["text"]) for r in kept_documents(first, index).collect()) == want
    assert sorted(map(tuple, index.rows().select("text_sha256", "keep_id").collect())) == before
    # half of the batch had come in when the job failed
    halves = {r["batch"] for r in index.rows().select("batch").distinct().collect()}
    spark.sql(f"ALTER TABLE {index.table} DROP PARTITION (batch = '{sorted(halves)[1]}')")
    assert sorted((r["doc_id"], r["text"]) for r in kept_documents(first, index).collect()) == want
    second = docs_of(["two", "new", "one "], ids=[10, 11, 12])
    assert [r["doc_id"] for r in kept_documents(second, index).collect()] == [11]
    assert sorted((r["doc_id"], r["text"]) for r in kept_documents(first, index).collect()) == want
    spark.sql(f"DROP TABLE {index.table}")  # as a new session finds it
    again = DigestIndex(spark, "retry")
    assert again.buckets == 3 and again.rows().count() == 4
    assert [r["doc_id"] for r in kept_documents(second, again).collect()] == [11]
    again.drop()
    assert DigestIndex(spark, "retry").rows().count() == 0


def test_columns_may_have_any_name_and_type(spark):
    rows = [(1, "a b", 5, {"k": 1}, "x"), (1, "a  b", 6, {"k": 2}, "y"), (None, "q", 7, None, None), (None, "q", 7, {"k": 3}, "z"), (2, None, 8, {}, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, row map<string,int>, sha string")
    df = df.selectExpr("*", "3 as _sha", "4 as _n", "5 as _points", "6 as n", "7 as id", "8 as `a.b`", "9 as order", "10 as keep_id")
    got = kept_documents(df)
    assert got.columns == df.columns
    out = sorted(got.collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], r["text"], r["_id"]) for r in out] == [(1, "a  b", 6), (2, None, 8), (None, "q", 7)]
    assert all((r["_sha"], r["_n"], r["_points"], r["n"], r["id"], r["a.b"], r["keep_id"]) == (3, 4, 5, 6, 7, 8, 10) for r in out)
    assert kept_documents(df.filter("false")).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", "y")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in exact_dedup(df).filter("kept").collect()) == ["a", "c"]


def test_repeated_rows_keep_one(docs_of):
    df = docs_of(["same", "same", "same", "other"], ids=[1, 1, 2, 2])
    assert sorted((r["doc_id"], r["text"]) for r in kept_documents(df).collect()) == [(1, "same"), (2, "other")]
