import random
import zlib

import numpy as np
from brute_profiles import profile

from sparkrecall.llm.langid import identify, keep_known

TRUE = {"aa": "abcd efab cdda", "bb": "xyzw wvzx yyxz", "cc": "éèà çâê ùéà"}


def text(rnd, lang, n):
    return "".join(rnd.choice(TRUE[lang]) for _ in range(n))


def test_held_out_accuracy_and_edges(docs_of):
    rnd = random.Random(4)
    langs = [rnd.choice(list(TRUE)) for _ in range(300)]
    texts = [text(rnd, x, rnd.randint(30, 400)) for x in langs] + [None, "", "123 %%%", "ab" * 1_500_000, text(rnd, "bb", 100), "Ж"]
    langs += ["aa", "bb", "cc", "aa", None, None]
    got = {r["doc_id"]: r for r in identify(docs_of(texts, langs).selectExpr("*", "1 as score")).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert len(held) > 40 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[304]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in keep_known(docs_of(texts, langs)).collect()}
    assert kept == {i for i in got if got[i]["lang_pred"] != "und" and 2 * got[i]["score"] - 1 >= 3 / 32}
    only = {r["doc_id"] for r in keep_known(docs_of(texts, langs), ["bb", "zz"]).collect()}
    assert only == {i for i in kept if got[i]["lang_pred"] == "bb"}


def test_predictions_against_vectors_built_letter_by_letter(docs_of):
    rnd = random.Random(6)
    langs = [rnd.choice(list(TRUE)) for _ in range(60)]
    texts = [text(rnd, x, rnd.randint(3, 60)) + rnd.choice(["", "  12 ", "-q"]) for x in langs]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    own = [profile(t) for t in texts]
    taught = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({langs[i] for i in taught})
    protos = [unit(sum(own[i] for i in taught if langs[i] == x)) for x in names]
    mean = sum(protos) / len(protos)
    for r in identify(docs_of(texts, langs)).collect():
        cos = [unit(own[r["doc_id"]] - mean) @ unit(p - mean) for p in protos]
        assert r["lang_pred"] == names[int(np.argmax(cos))] and abs(r["score"] - (1 + max(cos)) / 2) < 1e-4


def test_nothing_to_learn(docs_of):
    assert [r["lang_pred"] for r in identify(docs_of(["abc"], [None])).collect()] == ["und"]
    assert identify(docs_of([])).count() == 0
    assert [r["text"] for r in keep_known(docs_of(["abc", "1", None], [None] * 3)).collect()] == ["abc"]


def test_labels_are_not_inputs(docs_of):
    rnd = random.Random(5)
    texts = [text(rnd, x, 80) for x in list(TRUE) * 30]
    base = docs_of(texts, list(TRUE) * 30)
    other = docs_of(texts, ["aa"] * 90)
    a = {r["doc_id"]: r["lang_pred"] for r in identify(base).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in identify(other, base).collect()}
    assert a == b
