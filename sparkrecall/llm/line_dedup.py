"""Line dedup over content-defined chunks (DataFrame operations only).

A text's lines are hashed; a rolling hash over the last WINDOW line hashes
chooses chunk boundaries, so the same lines are cut alike wherever they stand.
A line of LONG words or more is a chunk of its own. Chunks of two lines or more,
and such long lines, are compared over the whole corpus: first by a 64-bit hash
(only hashes are shuffled), then, for hashes that repeat, by their bytes. Of
equal chunks the first by doc_id, then by position, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, DIVISOR, LONG, BASE = 2, 4, 50, 31


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, " ", -1), lambda w: w != ""))


def with_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines): th tells texts of a repeated doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, n, chunk) of every chunk that may be compared; start
    counts lines from 0."""
    rows = with_lines(docs.filter("text is not null"))
    rows = rows.select("*", F.transform("lines", line_hash).alias("h"), F.transform("lines", lambda x: n_words(x) >= LONG).alias("long"))
    last = F.size("lines") - 1
    rolled = F.col("h")
    ends = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: F.get("long", i)
        | F.coalesce(F.get("long", i + 1), F.lit(True))
        | (_rolling(rolled, i) % DIVISOR == 0),
    )
    rows = rows.select("doc_id", "th", "lines", "long", ends.alias("ends"))
    spans = F.transform(
        "ends",
        lambda e, k: F.struct((F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 1).alias("start"), e.alias("end")),
    )
    wanted = F.filter(spans, lambda s: (s["end"] > s["start"]) | F.get("long", s["start"]))
    rows = rows.select("doc_id", "th", "lines", F.explode(wanted).alias("s"))
    n = F.col("s.end") - F.col("s.start") + 1
    return rows.select(
        "doc_id", "th", F.col("s.start").alias("start"), n.alias("n"), F.array_join(F.slice("lines", F.col("s.start") + 1, n), "\n").alias("chunk")
    )


def _rolling(h: Column, i: Column) -> Column:
    out = F.get(h, i)
    for k in range(1, WINDOW):
        out = out + F.lit(BASE**k) * F.coalesce(F.get(h, i - k), F.lit(0).cast("long"))
    return out


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, n) of every chunk that an earlier place already has."""
    spark = docs.sparkSession
    hashed = chunks(docs).withColumn("hash", F.xxhash64("chunk"))
    twice = hashed.groupBy("hash").count().filter("count > 1").select("hash")
    twice = materialize(spark, twice, "chunk-hashes")
    found = materialize(spark, hashed.join(twice.hint("merge"), "hash", "left_semi"), "chunk-places")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "start")
    # grouping by the text itself is the comparison of bytes
    first = found.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1")
    first = materialize(spark, first.select(F.col("hash").alias("_hash"), F.col("chunk").alias("_chunk"), "first"), "first-places")
    both = found.join(first.hint("merge"), (F.col("hash") == F.col("_hash")) & (F.col("chunk") == F.col("_chunk")))
    return both.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "start", "n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, text without the lines of
    repeated chunks.

    A null text stays null and has no lines; an empty text has one empty line;
    rows repeated in full count as one place and are cleaned alike; a null
    doc_id comes after all others; an empty table gives no rows; only doc_id and
    text are read. A document whose chunks all stand elsewhere becomes empty.
    """
    spark = docs.sparkSession
    gone = repeated_chunks(docs).distinct().select("doc_id", "th", F.sequence(F.col("start"), F.col("start") + F.col("n") - 1).alias("at"))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.flatten(F.collect_list("at")).alias("gone"))
    gone = materialize(spark, gone, "repeated-lines")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    lines = F.split("text", "\n", -1)
    # a text with nothing to remove is passed on as it is
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    rows = rows.select("doc_id", "text", "gone", lines.alias("lines"))
    return rows.select(
        "doc_id",
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        clean.alias("text"),
    )
