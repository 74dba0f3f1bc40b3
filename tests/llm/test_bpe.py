import hashlib

import pytest

from sparkrecall.llm.bpe import PIECE, codec, decode_ids, encode_texts, encode_words, pack, piece_table, squeeze, stretch, unpack, word_blocks

P = pytest.importorskip("public_tokenizers")


def test_equals_the_library(spark, docs_of, words):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [
        "Hello  World's é 日本 <|endoftext|> Á 123 x!!'s", None, "", " \n\t", "don't I'LL ''s '' 'stop", "İstanbul ǅ ß ﬁ ½ ²",
        "<|STARTOFTEXT|> <|startoftext|><|endoftext|>", "​zero‍﻿\x00\x1c\x85  end", "🎉👩‍👩‍👧 नमस्ते ไทย العربية", "a" * 20_000,
        " ".join(words) * 20, "x<|endoftext", "é <|endoftext|>́e", "ȩ́ 가",
    ]
    want = {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (ids, t.decode(ids, skip_special_tokens=False))
    for chars in (1 << 20, 200):
        got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in encode_texts(docs_of(texts), path, "ids", chars).collect()}
        assert got == want
    again = encode_texts(docs_of(texts), path, "ids", 200).unionByName(encode_texts(docs_of([None], ids=[99]), path, "ids").selectExpr("doc_id", "null as ids", "decoded"))
    got = {r["doc_id"]: r["decoded"] for r in decode_ids(again, path).collect()}
    assert got == {**{i: x[1] for i, x in want.items()}, 99: ""}
    for r in encode_texts(docs_of(texts).selectExpr("*", "1 as ids", "2 as word", "3 as n"), path).collect():
        ids, decoded = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert encode_texts(docs_of([]), path).count() == 0


def test_every_distinct_word_is_encoded_once(spark, docs_of, words):
    path = P.path("word_bpe_49k.json")
    texts = [" ".join(words[k : k + 40]) for k in range(0, 360, 20)] * 3
    blocks = word_blocks(docs_of(texts).repartition(3), path, 8, 500)
    assert blocks.count() > 3
    spread = blocks.selectExpr("block", "explode(words) as w").select("block", "w.part", "w.words")
    by_word = {}
    for r in spread.collect():
        for w in unpack(r["words"]):
            by_word.setdefault(w.decode(), set()).add(r["part"])
    assert set(by_word) == set(words[:380]) and all(len(x) == 1 for x in by_word.values())
    done = encode_words(spread, path, 4).collect()
    assert len(done) == spread.count() and piece_table(spark, path).count() == len(codec(path).pieces)


def test_packing():
    import numpy as np

    for a in (np.zeros(0, np.uint32), np.array([0, 1, 70_000, 1 << 31], np.uint32)):
        assert (stretch(squeeze(a)) == a).all()
    assert unpack(pack([b"", b"ab", b"c"])) == [b"", b"ab", b"c"] and unpack(pack([])) == []


def test_long_texts_are_split_piece_by_piece():
    own = codec(P.path("word_bpe_49k.json"))
    text = "ab \n cd  " * (PIECE // 4) + "<|endoftext|>" + "x" * (PIECE + 5) + " y"
    pieces = list(own.words(text))
    assert len(pieces) > 3 and [w for p in pieces for w in p] == text.replace("<|endoftext|>", " <|endoftext|> ").split()
