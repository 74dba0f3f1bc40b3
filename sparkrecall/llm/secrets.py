"""Secret scans with multipart credential linking (DataFrame operations only).

Base detectors report assignments, access identifiers and long hexadecimal
strings wherever they stand. Weak candidates (login names, unlabelled 40-letter
secrets, endpoints) mean little alone: they are parts of a credential only next
to complementary parts. Parts are therefore joined as intervals: two parts link
if they are at most ``scope`` code points apart in the same text, found by an
equi-join on the scope-sized cells that a part touches and a test of the gap.

- a weak identifier needs a secret: a base assignment or hex string, or a weak
  secret that itself is backed by an endpoint;
- a weak secret needs an identifier: a base access identifier, or a weak one
  that itself is backed by an endpoint;
- an endpoint needs both an identifier and a secret, one of them at least from
  a base detector.

Kinds, in the order that breaks ties of position: assign, access, hex,
weak_id, weak_secret, endpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 400

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern for Java, group whose length counts, least length); a match that is too short is dropped.
BASE = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "weak_id": (rf"(?i:access_?key(?:_?id)?|client_?id|user_?name|login|account){_VALUE}([A-Za-z0-9_.@-]+)", 1, 4),
    "weak_secret": (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:endpoint|hostname?|server)" + _VALUE + r"[A-Za-z0-9.:/-]+)", 0, 8),
}


_NONE = "array<struct<start:int,k:int,end:int>>"


def running_sums(values: Column, block: int = 512) -> Column:
    """Sums up to and with each element. Arrays grow by copying, so sums run
    within blocks, and the blocks' totals run by themselves: a text with very
    many matches stays cheap."""
    empty = F.array().cast("array<int>")

    def run(xs: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    n = F.ceil(F.size(values) / block).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(values, (i - 1) * block + 1, block))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
    starts = F.zip_with(run(totals, F.lit(0)), totals, lambda upto, own: upto - own)
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(parts, starts, run))).otherwise(empty)


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches of a pattern as sorted (start, k, end)
    in code points. The pieces between matches and the matches themselves
    alternate, so their lengths add up to the positions."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    # from one start to the next: the match before, then what lies between
    steps = F.zip_with(F.slice(between, 1, F.size(found)), F.concat(F.array(F.lit(0)), found), lambda g, f: g + f)
    steps = F.filter(steps, lambda x: x.isNotNull())
    order = F.lit(KINDS.index(kind))
    rows = F.zip_with(
        F.zip_with(running_sums(steps), found, lambda s, n: F.struct(s.alias("start"), order.alias("k"), (s + n).alias("end"))),
        measured,
        lambda r, m: F.struct(r.alias("r"), m.alias("m")),
    )
    done = F.transform(F.filter(rows, lambda x: x["m"] >= least), lambda x: x["r"])
    # most texts have no match: they pay one search and no arrays
    return F.when(text.rlike(pattern), done.cast(_NONE)).otherwise(F.array().cast(_NONE))


def joined(parts: Column) -> Column:
    """kind:start:end, comma-joined, of a sorted array of (start, k, end)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["start"], p["end"])), ",")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of ``left`` for which some part of ``right`` in the same text lies
    within ``scope``. Every part touches the cells from its start to its end;
    the left one looks one cell further on either side."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    one = left.withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
    two = right.select(
        F.col("row").alias("r_row"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), cells(F.col("start"), F.col("end")).alias("r_cell")
    )
    hit = (
        (F.col("row") == F.col("r_row"))
        & (F.col("cell") == F.col("r_cell"))
        & (F.col("r_start") <= F.col("end") + scope)
        & (F.col("start") <= F.col("r_end") + scope)
    )
    return one.join(two, hit, "left_semi").select(left.columns).distinct()


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that count: ``parts`` is (row, start, k, end)."""
    of = lambda *kinds: parts.filter(F.col("k").isin([KINDS.index(x) for x in kinds]))
    ends = of("endpoint")
    ids = of("weak_id")
    secrets = of("weak_secret")
    strong_id, strong_secret = of("access"), of("assign", "hex")
    backed_id, backed_secret = _near(ids, ends, scope), _near(secrets, ends, scope)
    good_ids = _near(ids, strong_secret.unionByName(backed_secret), scope)
    good_secrets = _near(secrets, strong_id.unionByName(backed_id), scope)
    any_id, any_secret = strong_id.unionByName(ids), strong_secret.unionByName(secrets)
    good_ends = _near(_near(ends, strong_id, scope), any_secret, scope).unionByName(_near(_near(ends, any_id, scope), strong_secret, scope))
    return good_ids.unionByName(good_secrets).unionByName(good_ends).distinct()


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, base, weak): row is a digest of id and text, and weak is not
    null, only where a weak part stands beside another part."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = F.array_sort(F.concat(*(spans(F.col("t"), k, *p) for k, p in BASE.items())))
    weak = F.concat(*(spans(F.col("t"), k, *p) for k, p in WEAK.items()))
    found = rows.select("doc_id", "t", base.alias("base"), weak.alias("weak"))
    open_ = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "t"), 256)
    return found.select("doc_id", F.when(open_, key).alias("row"), "base", F.when(open_, F.col("weak")).alias("weak"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, base (array of start, k, end), parts (the same
    with linked weak parts; sorted by start, then kind).

    Null counts as empty; empty texts and texts without secrets have empty
    arrays; rows repeated in full share their result; the same doc_id with
    another text is another text; an empty table gives no rows; no column but
    the two named is read.
    """
    spark = docs.sparkSession
    found = materialize(spark, find_parts(docs, id_col, text_col), "secret-parts")
    parts = (
        found.filter("row is not null")
        .select("row", F.explode(F.concat("base", "weak")).alias("p"))
        .select("row", "p.start", "p.k", "p.end")
        .distinct()
    )
    more = F.collect_list(F.struct("start", "k", "end")).alias("more")
    good = materialize(spark, link(parts, scope).groupBy(F.col("row").alias("_row")).agg(more), "linked-parts")
    out = found.join(good.hint("merge"), F.col("row") == F.col("_row"), "left")
    none = F.array().cast(_NONE)
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("parts"))


def n_of(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda p: p["k"] == KINDS.index(kind))).cast("long")
