import random

from sparkrecall.llm.simhash import similar_components


def shingles(t, k=5):
    w = t.lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def test_links_are_the_pairs_at_the_threshold(words, docs_of):
    rnd, texts = random.Random(21), []
    for k in range(60):
        w = rnd.choices(words, k=rnd.choice([9, 12, 30, 200, 300]))
        v = list(w)
        if len(w) < 100:
            v.append("tail")
        else:
            # eight to fourteen changes of five shingles each: similarities around 0.8
            for at in rnd.sample(range(0, len(v), 10), (len(v) * rnd.randint(4, 14)) // 400 * 2 or 1):
                v[at] = "other%d" % at
        texts += [" ".join(w), " ".join(v)]
    sets = [shingles(t) for t in texts]
    sim = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.65 <= s < 0.8 for s in sim) > 5 and sum(0.8 <= s < 0.9 for s in sim) > 5
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(texts)).collect()}
    assert got == {i: i - i % 2 if sim[i // 2] >= 0.8 else i for i in range(len(texts))}
