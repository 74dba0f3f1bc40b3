import random
import re

import numpy as np
import xxhash

from sparkrecall.llm.simhash import (
    BitPlanes,
    _rows_of_bytes,
    fingerprints,
    forest,
    near_components,
    near_dedup,
    shingle_fingerprint,
    similar_components,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_fp(text, k=3):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, fps[i], low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(words, n=150, seed=1):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            w = out[rnd.randrange(len(out))].split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choices(words, k=rnd.randint(1, 400))))
    return out + [None, "", "  \n", "One", "one", "A b", "ÀB c d e", "x" * 300_000, "long words " * 20_000]


def test_against_brute_force(words, docs_of):
    texts = corpus(words)
    ids = list(range(5, 5 + len(texts)))
    random.Random(3).shuffle(ids)
    got = near_components(docs_of(texts, ids=ids)).collect()
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got)
    assert got == brute_components(list(zip(ids, texts)))


def test_blocks_of_long_texts_join(words):
    text = " ".join(random.Random(5).choices(words, k=200_000))
    assert shingle_fingerprint(text.encode()) == brute_fp(text)


def test_bit_planes_match_popcounts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(0xF0F), base ^ np.uint64(1 << 63)])
    rows = _rows_of_bytes(fps.view(np.int64))
    planes = BitPlanes(rows)
    for radius in (0, 1, 2, 3, 4, 7, 10, 12, 80):
        for k in range(0, len(fps), 7):
            want = sum(1 << i for i, f in enumerate(map(int, fps)) if (f ^ int(fps[k])).bit_count() <= radius)
            assert planes.within(k, radius) == want
    assert len(forest(rows, 3)) == 80  # base, base ^ 5 and base with the top bit set


def jaccard(a, b, k=5):
    def sh(t):
        w = t.lower().split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}

    return len(sh(a) & sh(b)) / len(sh(a) | sh(b))


def test_similar_texts_link_and_others_stay(words, docs_of):
    rnd, texts, base = random.Random(8), [], []
    line = " ".join(rnd.choices(words, k=12))
    for _ in range(60):
        w = rnd.choices(words, k=rnd.randint(120, 500))
        base.append(len(texts))
        texts.append(" ".join([line, *w]))
        for _ in range(3):
            v = list(w)
            for _ in range(rnd.choice([1, 2, 20])):
                v[rnd.randrange(len(v))] = "changed%d" % rnd.randrange(10**6)
            texts.append(" ".join([line, *v]))
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(texts)).collect()}
    for b in base:
        for i in range(b, b + 4):
            j = max(jaccard(texts[i], texts[k]) for k in range(b, b + 4) if k != i)
            if j >= 0.88:
                assert any(got[i] == got[k] for k in range(b, b + 4) if k != i), j
            if j < 0.65:
                assert got[i] == i
    assert all(got[i] // 4 == i // 4 for i in got)
    kept = {r["doc_id"] for r in near_dedup(docs_of(texts)).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_chain_of_links_is_one_component(spark, docs_of, monkeypatch):
    import sparkrecall.llm.simhash as m

    fps = [(1 << k) - 1 for k in range(0, 60, 2)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(m, "CHUNK", 2)  # a hot key is dealt out as a grid
    from sparkrecall.llm.components import connected_components

    labels = connected_components(m.link(df, 3)).collect()
    assert {r["node"] for r in labels} == set(fps) and {r["label"] for r in labels} == {0}


def test_edge_cases(docs_of):
    assert near_components(docs_of([])).count() == 0
    df = docs_of([None, "", "a b c", "a b c", "a b c"], ids=[7, 3, None, 5, 5]).selectExpr("*", "1 as fp", "2 as rep", "3 as label")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_components(df).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 5), (5, 5), (5, 5)], key=str)
    assert sorted(r["doc_id"] for r in near_dedup(docs_of(["a b c d", "a b c d", "zz yy xx ww"])).collect()) == [0, 2]
    assert fingerprints(docs_of(["x"])).collect()[0]["fp"] != 0
