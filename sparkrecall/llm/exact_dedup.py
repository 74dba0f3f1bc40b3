"""Exact dedup through a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, one row per distinct
normalised text. A batch is digested once, reduced to one row per digest before
any join, compared with the index by a sort-merge anti-join that does not
shuffle the index, and what is new is appended. A batch goes in by halves, the
longer texts first, so that within a batch too the index tells what is new.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import children, delete_path, materialize, release, shared_dir, written

WHITE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, SHA-256 of the text without white space, code points of the
    original text, and a row number that tells repeated rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(text, WHITE, ""), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest
    doc_id with null last, then first row)."""
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "row_no"))
    return (
        rows.groupBy("text_sha256")
        .agg(best.alias("b"))
        .select(
            "text_sha256",
            F.col("b.doc_id").alias("keep_id"),
            F.col("b.row_no").alias("keep_row"),
            (-F.col("b.n")).alias("keep_points"),
        )
    )


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far, one row per digest.

    It lies in the shared folder, under ``name``, and outlives the session: the
    same name opens it again, with the buckets that it was made with. Every batch
    is a partition of its own and is overwritten as a whole, so that appending
    the same batch again, after a crash or not, gives the same index. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.id_type = spark, id_type
        self.folder = f"{shared_dir(spark)}/digest-index-{name or uuid.uuid4().hex}"
        found = [re.fullmatch(r"buckets-(\d+)", x) for x in children(spark, self.folder)]
        known = [int(m[1]) for m in found if m]
        self.buckets = known[0] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{self.folder}/buckets-{self.buckets}"
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (text_sha256 string, keep_id {id_type}, keep_row bigint, keep_points bigint, batch string) "
                f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.path}'"
            )
            if known:
                spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, new: DataFrame, batch: str, own: tuple[str, ...] = ()) -> None:
        """Add those digests of ``new`` (from :func:`groups`) that no other batch
        has. ``own`` names batches of the same delivery that a retry rewrites
        later: what they hold from an earlier attempt does not count."""
        others = self.rows().filter(~F.col("batch").isin(batch, *own)).select("text_sha256")
        fresh = new.join(others.hint("merge"), "text_sha256", "left_anti").select("text_sha256", "keep_id", "keep_row", "keep_points")
        mark = written()
        fresh = materialize(self.spark, fresh, "fresh-digests")
        fresh.createOrReplaceTempView(view := f"fresh_{uuid.uuid4().hex}")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{batch}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)
        release(self.spark, mark)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.folder)


def batch_id(rows: DataFrame) -> str:
    """A digest of a batch's rows: the same rows are the same batch."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text_sha256", "n_points").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n} {total}".encode()).hexdigest()[:32]


def _indexed(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Append ``rows`` to the index, the longer texts first, and return one row
    per digest: the row that stays, whether this batch brought it, group_size.

    The longest text of a group stays. Whatever the length that divides the
    batch, a group with a row in the first half has its longest row there, so the
    first half may settle its digests before the second is compared with it.
    """
    halves = (f"{batch}-0", f"{batch}-1")
    middle = rows.agg(F.percentile_approx("n_points", 0.5)).first()[0] or 0
    index.append(groups(rows.filter(F.col("n_points") >= middle)), halves[0], halves[1:])
    index.append(groups(rows.filter(F.col("n_points") < middle)), halves[1])
    sizes = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    return sizes.join(index.rows().hint("merge"), "text_sha256").select(
        F.col("text_sha256").alias("_sha"), "keep_id", "keep_row", F.col("batch").isin(*halves).alias("own"), "group_size"
    )


def exact_dedup(
    docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Annotate every row with the row that stays of its group.

    Returns doc_id, keep_id, group_size (rows of this batch), kept, text_sha256
    and row_no. A digest that another batch of the index has keeps its document,
    and no row of this batch is kept. ``batch`` names the batch; by default it is
    a digest of its rows. The same batch again gives the same rows again.

    Null text counts as empty; rows repeated in full are told apart by row
    number, so that exactly one stays; of equally long texts the smallest doc_id
    stays, null last; an empty table gives no rows; other columns of ``docs`` are
    not read, so their names cannot clash. Without an index, one is made and
    dropped again.
    """
    spark = docs.sparkSession
    rows = materialize(spark, digests(docs, id_col, text_col), "digests")
    own = index or DigestIndex(spark, id_type=rows.schema["doc_id"].dataType.simpleString())
    # written out: a hot digest can then be split, which a bucketed side forbids
    kept = materialize(spark, _indexed(rows, own, batch or batch_id(rows)), "kept-digests")
    if index is None:
        own.drop()
    out = rows.join(kept.hint("merge"), F.col("text_sha256") == F.col("_sha"), "left")
    is_kept = F.col("own") & (F.col("row_no") == F.col("keep_row"))
    return out.select("doc_id", "keep_id", "group_size", is_kept.alias("kept"), "text_sha256", "row_no")


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one per distinct text.

    Only ids and digests are joined back. Of rows with the same doc_id (null
    included) and digest the longest text stays, then the one with the smallest
    hash of its text, then of its other columns as JSON. Null text counts as
    empty; columns may have any name and type; an empty table gives no rows.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    keys = exact_dedup(docs, index, batch).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    keys = materialize(spark, keys, "kept")
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    # the caller's columns travel in one struct, so that no name can clash
    packed = docs.select(
        F.struct(*quoted).alias("row"),
        F.col("doc_id").alias("id"),
        F.sha2(F.regexp_replace(text, WHITE, ""), 256).alias("sha"),
        F.struct((-F.char_length(text)).alias("n"), F.xxhash64("text").alias("h"), F.to_json(F.struct(*others)).alias("j") if others else F.lit("").alias("j")).alias("order"),
    )
    same = packed["id"].eqNullSafe(keys["id"]) & (packed["sha"] == keys["sha"])
    found = packed.join(keys.hint("merge"), same, "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "sha").orderBy("order"))
    return found.withColumn("n", first).filter("n = 1").select("row.*")
