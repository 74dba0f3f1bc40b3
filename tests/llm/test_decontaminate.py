import random
import re
from array import array

from pyspark.sql import functions as F

from sparkrecall.llm.decontaminate import PatternSet, decontaminate, find_contamination, n_hit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def cut(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = cut(t)
        for p in [tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))] if w else []:
            wins.setdefault(p, set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in {len(p) for p in wins}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[p]
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


def test_against_brute_force(spark, words, docs_of):
    rnd = random.Random(2)
    few = words[:12]
    items = [(k, " ".join(rnd.choices(few, k=rnd.randint(1, 25)))) for k in range(30)] + [(90, None), (91, "--"), (4, "Zeta, one"), (None, "nul id here")]
    texts = []
    for _ in range(60):
        w = rnd.choices(few, k=rnd.randint(0, 200))
        if rnd.random() < 0.5:
            w[3:3] = items[rnd.randrange(30)][1].upper().split()
        texts.append(rnd.choice([" ", ", ", "-", "\n"]).join(w))
    texts += [None, "", "zeta ONE", "é" * 10, "x y zeta one nul id here", " ".join(words) * 3000 + " " + items[3][1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as runs")
    for size in (8 << 20, 300):
        got = find_contamination(docs_of(texts).withColumn("runs", F.lit(1)), bench, block_bytes=size)
        got = got.select("doc_id", "n_words", n_hit(F.col("runs")).alias("h"), "items").collect()
        assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)), items)
        left = {r["doc_id"] for r in decontaminate(docs_of(texts), bench, block_bytes=size).collect()}
        assert left == {d for d, _, h, _ in brute(list(enumerate(texts)), items) if not h}


def test_shift_tables():
    p = PatternSet([(1, "a b c d e f g h i j"), (2, "q r")])
    short, t = p.tables
    n = p.words
    key = lambda x, y: n[x] << 32 | n[y]
    assert t.jump == 9 and t.table[key(b"i", b"j")] == -1 and t.table[key(b"a", b"b")] == 8 and short.length == 2
    assert list(t.search(array("I", [0]) * 50)) == []
    assert p.scan("x a b c d e f g h i j q r q") == (14, [(1, 13)], {1, 2})


def test_memory_of_the_tables():
    import tracemalloc

    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(30_000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=100))) for k in range(1500)]
    size = sum(len(t) + 16 for _, t in items)
    tracemalloc.start()
    patterns = PatternSet(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert patterns.scan(items[7][1])[2] == {7} and held < 25 * size


def test_columns_may_have_any_name(spark, docs_of):
    bench = spark.createDataFrame([(k, f"alpha{k} beta gamma") for k in range(20)], "item_id bigint, text string")
    docs = docs_of(["x alpha3 beta gamma", "clean", None, "alpha9 beta gamma"], ids=[None, 2, 3, 3]).selectExpr("*", "1 as id", "2 as h", "3 as th", "map('a', 1) as row")
    for size in (1 << 20, 100):
        left = decontaminate(docs, bench, block_bytes=size)
        assert left.columns == docs.columns and sorted((r["doc_id"], r["text"], r["id"], r["th"]) for r in left.collect()) == [(2, "clean", 1, 3), (3, None, 1, 3)]
        assert decontaminate(docs.filter("false"), bench, block_bytes=size).count() == 0


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_contamination(docs_of(["a"]), none).collect()[0]["items"] == []
    assert find_contamination(docs_of([]), none).count() == 0
    assert decontaminate(docs_of(["a", None]), none).count() == 2
