"""SimHash near-dedup with bit-sliced comparison.

1. Every text becomes a 64-bit fingerprint (majority of XXH64 bits over word
   shingles). Copies share one, so only distinct fingerprints go on.
2. Pigeonhole tables: 64 bits in radius + 2 blocks; two fingerprints within the
   radius agree on at least two whole blocks, so each pair of blocks is a key
   and fingerprints that share a key are candidates. Exact, with no cap.
3. A key's fingerprints are compared bit-sliced: bit planes lie vertically in
   wide integers, one pass of carry-save counters updates the distances of one
   fingerprint to all others, and a block is abandoned once all have passed the
   radius. A key with many fingerprints is dealt out as a grid of chunk pairs.
4. Each comparison gives a spanning forest of its links, not all its pairs;
   connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, word_blocks
from .components import connected_components

#: Fingerprints of one key that one comparison holds at most, twice.
CHUNK = 2048


def shingle_fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit majority fingerprint of a UTF-8 text; 0 if it has no word."""
    digest, keep = xxhash.xxh64_digest, shingle - 1
    counts, total = np.zeros(64, dtype=np.int64), 0
    tail: list[bytes] = []
    for words in word_blocks(data.lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lens + 1) - 1
            starts = (ends - lens)[: len(words) - keep].tolist()
            stops = ends[keep:].tolist()
            for at in range(0, len(starts), 65536):
                part = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536])])
                bits = np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1)
                counts += bits.sum(axis=0, dtype=np.int64)
                total += len(bits)
        tail = words[-keep:] if keep else []
    if not total:
        if not tail:
            return 0
        return int.from_bytes(digest(b" ".join(tail), seed), "big")
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long.

    Null and wordless texts have fingerprint 0. Only the two columns are read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (shingle_fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1)),
                dtype=np.uint64,
                count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def hex_fingerprint(col: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 blocks of 64 bits."""
    n, out, at = radius + 2, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append((at, width))
        at += width
    return out


def _keys(fp: F.Column, radius: int) -> F.Column:
    """One long per pair of blocks: number of the pair, then the blocks' bits."""
    blocks, keys = _blocks(radius), []
    for k, ((s1, w1), (s2, w2)) in enumerate(combinations(blocks, 2)):
        part = lambda s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))
        keys.append(F.lit(k << (w1 + w2)).cast("long").bitwiseOR(F.shiftleft(part(s1, w1), w2)).bitwiseOR(part(s2, w2)))
    return F.array(*keys)


class BitPlanes:
    """Fingerprints stored vertically: plane i holds bit i of each of them.
    ``fps`` are rows of bytes, all of one width."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.bits = np.unpackbits(fps, axis=1)
        packed = np.packbits(self.bits, axis=0, bitorder="little")
        self.planes = [int.from_bytes(packed[:, i].tobytes(), "little") for i in range(self.bits.shape[1])]
        self.all = (1 << self.n) - 1

    def within(self, k: int, radius: int) -> int:
        """Set of positions at distance <= radius of position k. Counters start so
        that they overflow on the first difference beyond the radius."""
        width = max(1, radius.bit_length())
        bias = (1 << width) - 1 - radius
        count = [self.all if bias >> j & 1 else 0 for j in range(width)]
        over, full = 0, self.all
        for plane, own in zip(self.planes, self.bits[k].tolist()):
            carry = plane ^ full if own else plane
            for j in range(width):
                count[j], carry = count[j] ^ carry, count[j] & carry
                if not carry:
                    break
            else:
                over |= carry
                if over == full:
                    return 0
        return full & ~over


def forest(fps: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Edges (root, member) by position that span the links among ``fps`` (rows
    of bytes). Two are compared directly. With ``alike``, only pairs within the
    radius that it confirms are links."""
    n, edges = len(fps), []
    if n == 2:
        near = np.unpackbits(fps[0] ^ fps[1]).sum() <= radius and (alike is None or alike(0, 1))
        return [(0, 1)] if near else []
    planes, unseen = BitPlanes(fps), (1 << n) - 1
    while unseen:
        root = (unseen & -unseen).bit_length() - 1
        unseen &= unseen - 1
        todo = [root]
        while todo and unseen:
            at = todo.pop()
            found = planes.within(at, radius) & unseen
            while found:
                low = found & -found
                k = low.bit_length() - 1
                found ^= low
                if alike is not None and not alike(at, k):
                    continue
                unseen ^= low
                edges.append((root, k))
                todo.append(k)
    return edges


def _rows_of_bytes(fps: np.ndarray) -> np.ndarray:
    return fps.astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)


def link(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of "within ``radius`` bits".

    ``distinct`` has one long column fp without repeats.
    """
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    shared = materialize(spark, keyed.groupBy("key").count().filter("count > 1"), "shared-keys")
    dealt = keyed.join(shared.hint("merge"), "key").withColumn("g", F.ceil(F.col("count") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    dealt = dealt.select("fp", "key", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    grid = dealt.groupBy("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")).agg(
        F.collect_list("fp").alias("fps")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for fps in batch.column(0):
                own = fps.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(own) == 2:
                    x, y = own.tolist()
                    if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= radius:
                        a.append(x)
                        b.append(y)
                    continue
                for i, j in forest(_rows_of_bytes(own), radius):
                    a.append(int(own[i]))
                    b.append(int(own[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return grid.filter("size(fps) > 1").select("fps").mapInArrow(run, "a long, b long")


def _assign(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Give each row (doc_id, fp) the smallest doc_id of the component of its fp."""
    spark = rows.sparkSession
    reps = materialize(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fps")
    labels = materialize(spark, connected_components(edges), "labels")
    named = reps.join(labels.hint("merge"), reps["fp"] == labels["node"], "left")
    named = materialize(spark, named.select("fp", "rep", "label"), "named")
    least = materialize(spark, named.filter("label is not null").groupBy("label").agg(F.min("rep").alias("low")), "least")
    ids = named.join(least.hint("merge"), "label", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    ids = materialize(spark, ids, "component-ids")
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    component_id is the smallest doc_id reachable over links, its own included.
    Null and wordless texts share fingerprint 0 and link like any other; a null
    doc_id gets a component but never names one unless no member has an id; rows
    repeated in full stay repeated; an empty table gives no rows; no column but
    the two named is read.
    """
    rows = materialize(docs.sparkSession, fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return _assign(rows, link(rows.select("fp").distinct(), radius))


# --- similarity of shingle sets -------------------------------------------------
#
# A radius of 3 in 64 bits finds copies that hardly differ. Texts whose sets of
# shingles have a Jaccard similarity of 0.8 differ in about 15 % of the bits of a
# fingerprint, too many for whole blocks to agree. Fingerprints are then WIDE
# bits long, so that the share of differing bits tells the similarity closely,
# and candidates come from bands of MinHash values. The distance is a filter only:
# a pair that passes links by the exact similarity of its two sets of hashes.

LANES, BANDS, BAND_ROWS = 8, 12, 4
WIDE = 64 * LANES
#: Shingle hashes that one comparison holds at most, twice.
CHUNK_HASHES = 1 << 20
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def radius_of(similarity: float) -> int:
    """Bits that differ on average between equally large sets of that Jaccard
    similarity, and ten standard deviations more, which covers the ties of very
    small sets too. Unrelated sets differ in half of all bits."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * share + 10 * np.sqrt(WIDE * share * (1 - share)))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have that Jaccard similarity or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """A further 64 bits from a hash (the finaliser of SplitMix64)."""
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles of a UTF-8 text."""
    digest, keep = xxhash.xxh64_intdigest, shingle - 1
    parts: list[np.ndarray] = []
    tail: list[bytes] = []
    for words in word_blocks(data.lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lens + 1) - 1
            spans = zip((ends - lens)[: len(words) - keep].tolist(), ends[keep:].tolist())
            parts.append(np.unique(np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)))
        tail = words[-keep:] if keep else []
    if not parts:
        return np.array([digest(b" ".join(tail), 42)] if tail else [], dtype=np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def wide_fingerprint(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """WIDE bits by majority over a set of hashes, and one key per band; an empty
    set has fingerprint 0 and one key of its own."""
    n = len(hashes)
    if not n:
        return bytes(WIDE // 8), [0]
    counts = np.zeros(WIDE, dtype=np.int64)
    low = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        wide = np.stack([_mixed(part, k) for k in range(LANES)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.uint16)
        low = np.minimum(low, (part[:, None] * _MIX[0] + _MIX[1]).min(axis=0))
    keys = []
    for b in range(BANDS):
        own = low[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes()
        keys.append(xxhash.xxh64_intdigest(own, b) - (1 << 63))
    return np.packbits(2 * counts > n).tobytes(), keys


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63)


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, n, wide, keys); fp stands for the set of n shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, found = [], [], []
            for t in batch.column(1):
                own = shingle_set((t.as_py() or "").encode(), shingle)
                fp.append(_set_id(own))
                n.append(len(own))
                found.append(wide_fingerprint(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array([w for w, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))],
                names=["doc_id", "fp", "n", "wide", "keys"],
            )
        give_back()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return out.mapInArrow(run, "doc_id long, fp long, n long, wide binary, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) per row; hashes are 8 bytes each, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set((t.as_py() or "").encode(), shingle) for t in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["fp", "hashes"]
                )
        give_back()

    return docs.select(F.col("text").alias("t")).mapInArrow(run, "fp long, hashes binary")


def link_wide(docs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """As :func:`link`, for ``rows`` of :func:`wide_fingerprints` over ``docs``:
    candidates share a band and are within the radius, links have ``similarity``."""
    spark, radius = rows.sparkSession, radius_of(similarity)
    distinct = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    distinct = materialize(spark, distinct, "distinct-wide")
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key")).distinct()
    shared = materialize(spark, keyed.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("hashes")).filter("count > 1"), "shared-bands")
    keyed = materialize(spark, keyed.join(shared.hint("merge"), "key"), "banded")
    # only texts that have a candidate are read again for their sets
    wanted = materialize(spark, distinct.join(keyed.select("fp").distinct().hint("merge"), "fp", "left_semi").select("fp", "wide", "doc_id"), "banded-wide")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = again.join(ids.hint("merge"), again["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    sets = materialize(spark, shingle_sets(again, shingle).dropDuplicates(["fp"]), "shingle-sets")
    dealt = keyed.withColumn("g", F.greatest(F.ceil(F.col("count") / CHUNK), F.ceil(F.col("hashes") / CHUNK_HASHES)).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    dealt = dealt.select("fp", "key", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    dealt = dealt.join(wanted.select("fp", "wide").join(sets.hint("merge"), "fp").hint("merge"), "fp")
    grid = dealt.groupBy("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")).agg(
        F.collect_list(F.struct("fp", "wide", "hashes")).alias("fps")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for row in batch.column(0):
                own = row.values
                ids = own.field(0).to_pylist()
                wide = np.frombuffer(b"".join(own.field(1).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in own.field(2)]
                for i, j in forest(wide, radius, lambda i, j: similar(sets[i], sets[j], similarity)):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return grid.filter("size(fps) > 1").select("fps").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) as :func:`near_components`, linking texts whose
    sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity``
    or more."""
    rows = materialize(docs.sparkSession, wide_fingerprints(docs, shingle), "wide-fingerprints")
    return _assign(rows.select("doc_id", "fp"), link_wide(docs, rows, shingle, similarity))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the
    document with the smallest doc_id. Rows that repeat that id stay together."""
    kept = similar_components(docs, shingle, similarity).filter("doc_id <=> component_id")
    kept = materialize(docs.sparkSession, kept.select(F.col("doc_id").alias("_id")).distinct(), "near-kept")
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
