"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words at white space, block of texts by block of texts.
   A block keeps its distinct words once and, for every place of every text, the
   number of the word that stands there. Blocks are written out.
2. The distinct words of all blocks are shuffled by word. A task thus has all
   blocks' entries of its words, encodes every distinct word once, and answers
   each block with ids in the order in which the block had listed the words.
3. Ids are joined back to the block and put in place by position. Blocks are a
   bucketed table, so that only the answers are shuffled for that.
4. For decoding, the distinct ids of all answers are joined with the id-to-piece
   table (both are bounded by the vocabulary), and pieces are put in place alike.

What is shuffled is distinct words of blocks and their ids: no text, no row per
word place, and no position. Only whole words go to the tokenizer: no id depends on what
stands beyond white space, which :class:`WordCodec` checks of the tokenizer that
it is given.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, materialize_bucketed

#: Characters of texts at which a block is closed.
BLOCK_CHARS = 32 << 20
#: Parts that words are dealt to by hash: a task holds the distinct words of one.
MIN_PARTS, MAX_PARTS = 64, 1 << 16
#: Bytes of input for each part beyond MIN_PARTS.
PART_BYTES = 64 << 20
#: Bytes of input for each bucket of blocks.
BUCKET_BYTES = 64 << 20
#: Characters that are split at once.
PIECE = 1 << 20


class WordCodec:
    """A word-level view of a tokenizer file.

    Special tokens cut a text wherever their strings stand; the rest is split at
    the characters that the normaliser takes for white space.
    """

    def __init__(self, path: str):
        # one thread a task: more would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        added = spec["added_tokens"]
        plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if not plain or spec["post_processor"] or spec["decoder"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this tokenizer's ids are not a function of single words")
        self.specials = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(self.specials, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest))) if longest else None
        white = [chr(c) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc")]
        blank = {c for c in white if self.tokenizer.normalizer.normalize_str(f"a{c}b") == "a b"}
        # str.split() also splits where the tokenizer does not; such texts take the slow way
        self.odd = re.compile("[" + "".join(map(re.escape, (c for c in white if c.isspace() != (c in blank)))) + "]")
        self.has_odd = any(c.isspace() != (c in blank) for c in white)
        self.slow = re.compile("[^" + "".join(map(re.escape, sorted(blank))) + "]+").findall
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [self.tokenizer.id_to_token(i) for i in range(size)]

    def words(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens in order, piece by piece."""
        for part, special in self.parts(text):
            if special:
                yield [part]
                continue
            at = 0
            while at < len(part):
                end = part.find(" ", at + PIECE) if at + PIECE < len(part) else -1
                piece = part if not at and end < 0 else part[at:] if end < 0 else part[at:end]
                yield self.slow(piece) if self.has_odd and self.odd.search(piece) else piece.split()
                at = len(part) if end < 0 else end

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's parts; whether each is a special token."""
        at = 0
        if self.cut and any(s in text for s in self.specials):
            for m in self.cut.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        if at < len(text):
            yield text[at:] if at else text, False

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(words), 2048):
            found = self.tokenizer.encode_batch(words[at : at + 2048], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in found]
        return [self.specials.get(w, x) for w, x in zip(words, out)]


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack(words: list[bytes]) -> bytes:
    """Byte strings as one: how many, how long, and what they hold."""
    lens = np.array([len(words), *map(len, words)], "<u4")
    return zstandard.compress(lens.tobytes() + b"".join(words), 3)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 * n + 4
    return [raw[s:e] for s, e in zip([4 * n + 4, *ends.tolist()], ends.tolist())]


class _Block:
    """Texts whose words are kept once."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.places, self.chars = [], [], [], 0
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def add(self, own: WordCodec, doc_id, text: str) -> None:
        at = [np.fromiter(map(self.known.__getitem__, ws), np.uint32, len(ws)) for ws in own.words(text)]
        self.ids.append(doc_id)
        self.sizes.append(sum(map(len, at)))
        self.places += at
        self.chars += len(text) + 64

    def row(self, n_parts: int) -> dict:
        """``at`` numbers the word of every place, the most frequent word first;
        ``part`` says to which part each word is dealt; ``words`` are the words of
        each part, in order of number."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        by_use = np.argsort(-np.bincount(places, minlength=len(self.known)), kind="stable")
        rank = np.empty(len(by_use), np.uint32)
        rank[by_use] = np.arange(len(by_use), dtype=np.uint32)
        listed = [w.encode() for w in self.known]
        part = np.fromiter((zlib.crc32(listed[k]) % n_parts for k in by_use), np.uint32, len(by_use))
        words: list[list[bytes]] = [[] for _ in range(n_parts)]
        for k, p in zip(by_use.tolist(), part.tolist()):
            words[p].append(listed[k])
        return {"ids": self.ids, "sizes": self.sizes, "at": squeeze(rank[places]), "part": squeeze(part),
                "words": [{"part": p, "words": pack(ws)} for p, ws in enumerate(words) if ws]}


def word_blocks(docs: DataFrame, path: str, n_parts: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of texts; see :class:`_Block`."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("ids", pa.list_(to_arrow_type(kind))), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("part", pa.binary()),
                        ("words", pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = codec(path), _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(own, doc_id, text.as_py() or "")
                if block.chars >= block_chars:
                    yield pa.RecordBatch.from_pylist([block.row(n_parts)], schema=schema)
                    block = _Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(n_parts)], schema=schema)
        del block
        give_back()

    columns = f"ids array<{kind.simpleString()}>, sizes array<int>, at binary, part binary, words array<struct<part:int,words:binary>>"
    return docs.select("doc_id", "text").mapInArrow(run, columns).withColumn("block", F.monotonically_increasing_id())


def encode_words(words: DataFrame, path: str, tasks: int) -> DataFrame:
    """(block, part, counts, ids, used) from (block, part, words): of each word, in
    the order given, the number of its ids, and all ids. All entries of a word
    meet in one task, which encodes it once. ``used`` are distinct ids that the
    task has not named before."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, named = codec(path), None, np.zeros(0, np.int32)
        table: dict[bytes, bytes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for block, part, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if part != now:
                        table, now = {}, part
                    listed = unpack(data)
                    new = [w for w in listed if w not in table]
                    table.update(zip(new, own.encode([w.decode() for w in new])))
                    found = [table[w] for w in listed]
                    ids = np.frombuffer(b"".join(found), "<u4")
                    used = np.setdiff1d(ids.astype(np.int32), named)
                    named = np.union1d(named, used)
                    counts = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                    rows.append({"block": block, "part": part, "counts": squeeze(counts), "ids": squeeze(ids), "used": used})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        del table
        give_back()

    dealt = words.select("block", "part", "words").repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part int, counts binary, ids binary, used array<int>")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary."""
    return spark.createDataFrame(pd.DataFrame(list(enumerate(codec(path).pieces)), columns=["id", "piece"]), "id int, piece string")


def _in_place(row: dict, pieces: list[str]) -> Iterator[tuple[object, np.ndarray, str]]:
    """(doc_id, ids, decoded text) of the texts of one block."""
    part, places = stretch(row["part"]), stretch(row["at"])
    found = sorted(row["parts"] or (), key=lambda x: x["part"])
    flat = np.concatenate([np.zeros(0, "<u4"), *(stretch(x["ids"]) for x in found)])
    n = np.concatenate([np.zeros(0, "<u4"), *(stretch(x["counts"]) for x in found)]).astype(np.int64)
    # answers stand part by part, in each part in order of number
    order = np.argsort(part, kind="stable")
    counts, starts = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    counts[order], starts[order] = n, np.cumsum(n) - n
    tokens = [pieces[i] for i in flat.tolist()]
    decoded = [" ".join(tokens[s : s + k]) for s, k in zip(starts.tolist(), counts.tolist())]
    del tokens
    at = 0
    for doc_id, size in zip(row["ids"], row["sizes"]):
        own = places[at : at + size]
        at += size
        n = counts[own]
        first = np.cumsum(n) - n
        ids = flat[np.repeat(starts[own] - first, n) + np.arange(int(n.sum()))]
        # a word may have no ids: then it has no piece to join either
        yield doc_id, ids, " ".join([decoded[k] for k in own[n > 0].tolist()])


def encode_texts(docs: DataFrame, path: str, output: str = "digest", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode and decode every text.

    ``output`` is ``ids`` (doc_id, ids array<int>, decoded string) or ``digest``
    (doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids as little-endian
    unsigned 32-bit integers, and of the decoded text in UTF-8).

    Null counts as empty: no ids, empty decoded text. Repeated rows are encoded
    each, an empty table gives no rows, and only doc_id and text are read. A very
    long text is a block of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, digest = docs.sparkSession, output == "digest"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = min(MAX_PARTS, max(MIN_PARTS, size // PART_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    blocks = materialize_bucketed(spark, word_blocks(docs, path, n_parts, block_chars), "word-blocks", buckets, "block")
    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.part", "w.words")
    encoded = materialize(spark, encode_words(words, path, buckets), "word-ids")
    # distinct ids and what they are joined with: as many as the vocabulary has
    named = encoded.select(F.explode("used").alias("id")).distinct().join(F.broadcast(piece_table(spark, path)), "id")
    pieces = [""] * len(codec(path).pieces)
    for r in named.collect():
        pieces[r["id"]] = r["piece"]
    shared = spark.sparkContext.broadcast(pieces)
    answers = encoded.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "ids")).alias("parts"))
    rows = blocks.select("block", "ids", "sizes", "at", "part").join(answers.hint("merge"), "block", "left").drop("block")

    kind = docs.schema["doc_id"].dataType
    if digest:
        extra = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        extra, columns = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], "ids array<int>, decoded string"
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *extra])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out, held = [], 0
                for doc_id, ids, text in _in_place(batch.slice(k, 1).to_pylist()[0], shared.value):
                    if digest:
                        out.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                        held += 200
                    else:
                        out.append((doc_id, ids.astype(np.int32), text))
                        held += 4 * len(ids) + len(text)
                    if held > 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)
        give_back()

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, {columns}")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids array<int>) with ``decoded``: a join of
    every id with the id-to-piece table. Null ids decode as none; an id outside
    the vocabulary has no piece; repeated rows are decoded each."""
    spark = encoded.sparkSession
    rows = materialize(spark, encoded.select("doc_id", "ids").withColumn("row_no", F.monotonically_increasing_id()), "encoded")
    tokens = rows.select("row_no", F.posexplode("ids").alias("at", "id")).join(F.broadcast(piece_table(spark, path)), "id")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    texts = tokens.groupBy("row_no").agg(F.array_join(pieces, " ").alias("text"))
    return rows.join(texts.hint("merge"), "row_no", "left").select("doc_id", "ids", F.coalesce("text", F.lit("")).alias("decoded"))
