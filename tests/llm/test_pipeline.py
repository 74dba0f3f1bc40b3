import importlib
import random
import re
import zlib

import numpy as np
import pytest
from brute_profiles import profile

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t, k=5):
    w = t.lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def brute(rows, items):
    learned = [profile(t) for i, t in rows if t and any(c.isalpha() for c in t) and zlib.crc32(str(i).encode()) % 4 != 2]
    english = np.sum(learned, axis=0)
    english /= np.linalg.norm(english)

    def speaks(text):
        return any(c.isalpha() for c in text) and profile(text) @ english >= 3 / 32

    from tokenizers import Tokenizer

    import public_tokenizers

    rows = [r for r in rows if r[1] and speaks(r[1])]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    rows = [(i, t) for i, t in rows if best[re.sub(r"[\x20\x09-\x0D]", "", t)] == (-len(t), i)]
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [(i, t) for i, t in rows if find(i) == i]
    wins = set()
    for t in items:
        w = WORD.findall(t.lower())
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    clean = []
    for i, t in rows:
        w = WORD.findall(t.lower())
        if not any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1)):
            clean.append((i, t))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tok.encode(t, add_special_tokens=False).ids for i, t in clean}


def test_rows_against_brute_force(spark, docs_of, words, tmp_path):
    rnd = random.Random(12)
    items = [" ".join(rnd.choices(words, k=14)) for _ in range(5)]
    texts = []
    for k in range(50):
        w = rnd.choices(words, k=rnd.randint(150, 260))
        if k % 9 == 0:
            w[20:20] = items[k % 5].split()
        texts += [" ".join(w)] * rnd.choice([1, 1, 2])
        if k % 4 == 0:
            texts.append("  ".join(w))
        if k % 3 == 0:
            v = list(w)
            v[rnd.randrange(len(v))] = "other"
            texts.append(" ".join(v))
    texts += [None, "", "123 456", "%%%", "wz", "qux vyk zzw", "123 wx"]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: list(r["ids"]) for r in out.collect()} == brute(list(enumerate(texts)), items)


def test_stages_keep_the_columns(spark, docs_of, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(["one two three", "four five six"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 2
        assert stage(spark, docs_of([]), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "ids", "decoded"]


def test_entry_names_every_operator():
    names = importlib.import_module("__spark_entry__").queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
