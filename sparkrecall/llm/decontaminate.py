"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive benchmark words (a shorter item
is one window). For each window length, a shift table over two-word blocks says
how far a scan may jump; a block that ends some pattern has shift 0 and leads to
the bucket of the patterns with that suffix, which are compared word by word. A
clean text is thus read about once every nine words. Benchmark words are numbers
and windows places in one array of them, so that a window costs one table entry
and a few bytes.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, word_blocks

#: Bytes of benchmark text in one pattern block; a larger set is searched block after block.
BLOCK_BYTES = 4 << 20
#: ASCII outside [0-9A-Za-z] separates words; A-Z are lower-cased; other bytes stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


class WuManber:
    """Search tables for windows of one length (in words).

    Words are numbers, windows are places in one array of numbers. One table maps
    a block of words to its shift or, where some window ends with that block (its
    shift is 0), to the bucket of those windows: -1 less its place in ``starts``.
    """

    def __init__(self, text: array, windows: np.ndarray, length: int):
        self.text, self.length = text, length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        table: dict[int, int] = {}
        for end in range(self.block, length):  # the shifts, smaller ones last
            shift = length - end
            for key in np.unique(self._keys(windows + end)).tolist():
                table[key] = shift
        keys = self._keys(windows + length)
        order = np.argsort(keys, kind="stable")
        self.starts = array("i", windows[order].astype(np.int32).tobytes())
        ends, firsts = np.unique(keys[order], return_index=True)
        self.after = array("i", np.append(firsts, len(order)).astype(np.int32).tobytes())
        for bucket, key in enumerate(ends.tolist()):
            table[key] = -1 - bucket
        self.table = table

    def _keys(self, ends: np.ndarray) -> np.ndarray:
        words = np.frombuffer(self.text, dtype=np.uint32).astype(np.int64)
        last = words[ends - 1]
        return last if self.block == 1 else words[ends - 2] << 32 | last

    def search(self, words: array) -> Iterator[tuple[int, int]]:
        """(start, place of the window) of every occurrence in numbered words."""
        n, length, pair, text = len(words), self.length, self.block == 2, self.text
        get, jump, i = self.table.get, self.jump, self.length - 1
        while i < n:
            s = get(words[i - 1] << 32 | words[i] if pair else words[i], jump)
            if s > 0:
                i += s
                continue
            at, bucket = i - length + 1, -1 - s
            own = words[at : i + 1]
            for k in range(self.after[bucket], self.after[bucket + 1]):
                start = self.starts[k]
                if text[start : start + length] == own:
                    yield at, start
            i += 1


class PatternSet:
    """All windows of some benchmark items and the item of each place."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = 10):
        self.words: dict[bytes, int] = {}
        text, ids, spans, number = array("I"), [], [], self.words
        for item_id, content in items:
            own = (content or "").encode().translate(FOLD).split()
            if own:
                spans.append((len(text), len(own)))
                ids.append(item_id)
                # 0 is for words that no item has
                text.extend([number.setdefault(w, len(number) + 1) for w in own])
        self.ids, self.begins = ids, [s for s, _ in spans]
        by_length: dict[int, list[np.ndarray]] = {}
        for s, n in spans:
            by_length.setdefault(min(n, window), []).append(np.arange(s, s + max(1, n - window + 1), dtype=np.int64))
        self.tables = [WuManber(text, np.concatenate(w), n) for n, w in sorted(by_length.items())]

    def item(self, place: int) -> object:
        return self.ids[bisect_right(self.begins, place) - 1]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Words of the text, merged [start, end) runs of hit words, items found."""
        data = (text or "").encode().translate(FOLD)
        keep = max((t.length for t in self.tables), default=1) - 1
        base, tail, total, get = 0, array("I"), 0, self.words.get
        hits: set[tuple[int, int]] = set()
        items: set = set()
        for words in word_blocks(data):
            total += len(words)
            own = tail + array("I", [get(w, 0) for w in words])
            for t in self.tables:
                for at, place in t.search(own):
                    # what lies wholly in the kept tail was found a block before
                    hits.add((base + at, base + at + t.length))
                    items.add(self.item(place))
            tail = own[len(own) - min(keep, len(own)) :] if keep else array("I")
            base = total - len(tail)
        return total, merge(list(hits)), items


class PatternBlock:
    """Items on their way to the workers, which build the tables once a process
    and keep those of one block only."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.key, self.window, self.items = uuid.uuid4().hex, window, items

    def patterns(self) -> PatternSet:
        if _BUILT.get("key") != self.key:
            _BUILT.clear()
            _BUILT.update(key=self.key, patterns=PatternSet(self.items, self.window))
        return _BUILT["patterns"]


_BUILT: dict = {}


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


_FOUND = "n_words long, runs array<bigint>, items array<string>"


def pattern_blocks(benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of the benchmark's items, and the blocks, broadcast.

    The benchmark is measured first and cut by hash into blocks of about
    ``block_bytes``, so that what goes to the executors at once stays bounded
    however many items there are. A block is dropped when the next is asked for.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).collect()[0][0] or 0
    n_blocks = max(1, -(-size // block_bytes))

    def blocks() -> Iterator[Broadcast]:
        for k in range(n_blocks):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
            block = spark.sparkContext.broadcast(PatternBlock([(r[0], r[1]) for r in part.toLocalIterator()], window))
            yield block
            if n_blocks > 1:
                block.unpersist()

    return n_blocks, blocks()


def _search(docs: DataFrame, patterns: Broadcast, finds_only: bool) -> DataFrame:
    """(doc_id, th, n_words, runs, items) of every row of ``docs`` (doc_id, th,
    text), or of those with a find."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = patterns.value.patterns()
        for batch in batches:
            keep, n_words, runs, items = [], [], [], []
            for k, text in enumerate(batch.column(2)):
                n, found, ids = search.scan(text.as_py())
                if found or not finds_only:
                    keep.append(k)
                    n_words.append(n)
                    runs.append([x for r in found for x in r])
                    items.append(sorted(str(i) for i in ids if i is not None))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "th", "n_words", "runs", "items"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, {_FOUND}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, end, start, end, ... of
    hit words) and items (ids, as sorted strings, of the items that occur).

    Null and wordless texts have no words and no hits; null and wordless items
    have no windows; an item without an id marks words but is not listed; an
    empty benchmark finds nothing; repeated rows are reported each. Only doc_id
    and text of ``docs``, item_id and text of ``benchmark`` are read. A benchmark
    of several blocks is searched block after block; each pass writes only its
    finds, which are put together by doc_id and a hash of the text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    n_blocks, blocks = pattern_blocks(benchmark, window, block_bytes)
    out = _search(rows, next(blocks), False)
    if n_blocks == 1:
        return out.drop("th")
    out = materialize(spark, out, "first-finds")
    finds = [out.filter("size(runs) > 0")] + [materialize(spark, _search(rows, b, True), "finds") for b in blocks]
    found = reduce(DataFrame.unionByName, finds).groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h"))
    # rows repeated in full have the same finds: a set of them is as long as there are blocks
    found = found.agg(F.collect_set("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    same = out["doc_id"].eqNullSafe(found["id"]) & (out["th"] == found["h"])
    both = out.select("doc_id", "th", "n_words").join(found.hint("merge"), same, "left").select("doc_id", "n_words", "runs", "items")

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[x for r in merge([p for own in rs or () for p in zip(own[::2], own[1::2])]) for x in r] for rs in batch.column(2).to_pylist()]
            items = [sorted(x or ()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "runs", "items"]
            )

    return both.mapInArrow(put_together, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def n_hit(runs: F.Column) -> F.Column:
    """Words in flat (start, end) runs."""
    signed = F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns.

    With one pattern block rows are filtered where they are read. Several are
    searched one after another, each pass writes the keys of its finds, and one
    anti-join takes them all out. Null and wordless texts stay, as does every row
    if the benchmark has no window; equal texts share one fate; an empty table
    gives no rows; other columns may have any name and type.
    """
    at = docs.columns.index("text")
    n_blocks, blocks = pattern_blocks(benchmark, window, block_bytes)
    if n_blocks == 1:
        patterns = next(blocks)

        def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = patterns.value.patterns()
            for batch in batches:
                yield batch.filter(pa.array([not search.scan(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    finds = [materialize(docs.sparkSession, _search(rows, b, True).select("doc_id", "th"), "finds") for b in blocks]
    found = reduce(DataFrame.unionByName, finds).distinct()
    # the caller's columns travel in one struct, so that no name can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    same = packed["id"].eqNullSafe(found["doc_id"]) & (packed["h"] == found["th"])
    return packed.join(found.hint("merge"), same, "left_anti").select("row.*")
