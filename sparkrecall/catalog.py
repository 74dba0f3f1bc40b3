"""The driver's queries over the reference's operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import control, redaction, scoring, text, vectors
from .operators import bm25, dispatcher, fusion, graph, models, rerank, search, tokens
from .operators.vector_index import VectorIndex
from .packaging import ensure_shipped
from .plans.search import hybrid_search
from .sources import files
from .streaming import doorbell

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shipped(spark)
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


# stated query sets: every row whose id is divisible by 50
STATED = "id % 50 = 0"


def _vec(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_COS = """
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.id AS query_id, e.id, greatest(-1.0, least(1.0, list_cosine_similarity(q.v, e.v))) AS s
          FROM e q, e WHERE q.id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM s)"""


@query(_COS + " SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark, t):
    v = _vec(t)
    return search.top_k(v, v.filter(STATED), 10).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(_COS + " SELECT id, round(max(s), 6) AS score FROM s GROUP BY id")
def cosine_maxpool(spark, t):
    v = _vec(t)
    return search.max_pool(v, v.filter(STATED)).select("id", r6(F.col("score")).alias("score"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 3 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], q), 6) END AS score
    FROM embeddings, q""")
def cosine_blob_ragged(spark, t):
    """Blobs of the wrong length score 0."""
    v = _vec(t).withColumn("blob", vectors.f32_as_blob("v"))
    v = v.withColumn("blob", F.when(F.col("id") % 7 == 3, F.expr("substring(blob, 1, octet_length(blob) - 3)")).otherwise(F.col("blob")))
    one = _vec(t).filter("id = 0").select("v").collect()[0][0]
    q = F.array(*[F.lit(float(x)) for x in one])
    back = vectors.blob_as_f32("blob")
    good = F.octet_length("blob") == 4 * len(one)
    return v.withColumn("b", back).select("id", F.when(good, r6(vectors.cosine(F.when(good, F.col("b")).otherwise(q.cast("array<float>")), q))).otherwise(0.0).alias("score"))


@query("""
    SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
           round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))
                 / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS abs_sum
    FROM embeddings""")
def l2_normalize(spark, t):
    unit = vectors.l2_normalize(F.col("v"))
    total = F.aggregate(F.transform(unit, F.abs), F.lit(0.0), lambda s, x: s + x)
    return _vec(t).select("id", r6(vectors.norm(F.col("v"))).alias("norm"), r6(total).alias("abs_sum"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    c AS (
        SELECT d.doc_id AS id, coalesce(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT q FROM q)), 0.0) AS v,
               d.n_chars / 100.0::DOUBLE AS bm25, d.n_chars AS n, coalesce(l.quality, 0)::DOUBLE AS imp, (d.lang = 'en')::INT::DOUBLE AS title
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
        LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)
    SELECT id, round((v * 0.7 + (1.0::DOUBLE / (1.0 + abs(bm25))) * 0.3) * (CASE WHEN n < 40 THEN greatest(0.3, n / 40.0::DOUBLE) ELSE 1.0 END)
           + 0.15 * title + 0.1 * imp, 6) AS score FROM c""")
def hybrid_score(spark, t):
    one = _vec(t).filter("id = 0")
    sims = search.max_pool(_vec(t), one)
    docs = t("documents").join(sims.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    docs = docs.join(t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    s = scoring.hybrid_score(
        F.coalesce("score", F.lit(0.0)), F.col("n_chars") / 100.0, F.col("n_chars"), F.coalesce("quality", F.lit(0)).cast("double"), (F.col("lang") == "en").cast("double")
    )
    return docs.select(F.col("doc_id").alias("id"), r6(s).alias("score"))


@query("""
    SELECT o_orderkey AS id, round(CASE WHEN n > 1 THEN 0.2 * (rn - 1) / (n - 1) ELSE 0.0 END, 6) AS bonus FROM (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
               count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def recency_bonus(spark, t):
    rows = t("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("valid_from"))
    return scoring.recency_bonus(rows, "o_custkey", "valid_from", "o_orderkey", 0.2).select(F.col("o_orderkey").alias("id"), r6(F.col("bonus")).alias("bonus"))


@query(r"""
    WITH p AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s_]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS a,
        list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(p_type), '[^\p{L}\p{N}\s_]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS b FROM part)
    SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS score FROM p""")
def token_jaccard(spark, t):
    return t("part").select(F.col("p_partkey").alias("id"), r6(scoring.token_jaccard(F.col("p_name"), F.col("p_type"))).alias("score"))


@query(r"""
    WITH d AS (SELECT doc_id AS id, n_chars, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY n_chars DESC, id) AS rn FROM d)
    SELECT id FROM r WHERE rn = 1 OR body = ''""")
def content_dedup(spark, t):
    docs = t("documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("relevance"), F.col("text").alias("content"))
    return rerank.content_dedup(docs).select("id")


def _label_cands(t) -> DataFrame:
    """Per label, its vectors with the cosine to vector 0 as relevance."""
    sims = search.max_pool(_vec(t), _vec(t).filter("id = 0")).withColumnRenamed("score", "relevance")
    rows = t("embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.join(sims, "id")


_CANDS = """
    WITH RECURSIVE q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    c AS (SELECT label AS query_id, vec_id AS id, embedding::DOUBLE[] AS v, greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], q))) AS relevance FROM embeddings, q)"""


def _mmr_sql(k: int, seed: bool, cands: str = "c") -> str:
    """Greedy picks at lambda 0.7, one per step and query; ties to the higher
    relevance, then the smaller id."""
    first = "row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id)" if seed else "row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, id)"
    return f""",
    f AS (SELECT query_id, id, v FROM (SELECT *, {first} AS n FROM {cands}) WHERE n = 1),
    p AS (
        SELECT query_id, [id] AS ids, [v] AS vs, 1 AS n FROM f
        UNION ALL
        SELECT query_id, list_append(any_value(ids), arg_max(id, o)), list_append(any_value(vs), arg_max(v, o)), any_value(n) + 1 FROM (
            SELECT p.query_id, p.ids, p.vs, p.n, x.id, x.v, {{'s': round(0.7 * x.relevance - 0.3 * greatest(0.0, list_max(list_transform(p.vs, lambda w: list_cosine_similarity(w, x.v)))), 12),
                   'r': x.relevance, 'i': -x.id}} AS o
            FROM p JOIN {cands} x ON x.query_id = p.query_id WHERE p.n < {k} AND NOT list_contains(p.ids, x.id))
        GROUP BY query_id),
    picks AS (SELECT query_id, arg_max(ids, n) AS ids FROM p GROUP BY 1)
    SELECT query_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1))::INT AS rank FROM picks"""


@query(_CANDS + _mmr_sql(20, True))
def mmr_scored(spark, t):
    return rerank.mmr_scored(_label_cands(t), 0.7, 20, seed_first=True)


@query(_CANDS + _mmr_sql(20, False))
def mmr_query(spark, t):
    return rerank.mmr_query(_label_cands(t), 0.7, 20)


@query(_CANDS + r""",
    d AS (SELECT c.*, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM c JOIN documents ON doc_id = id),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY relevance DESC, id) AS dup FROM d),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM u WHERE dup = 1 OR body = ''),
    h AS (SELECT query_id, id, v, relevance FROM b WHERE n <= 30)""" + _mmr_sql(10, True, "h"))
def rank_hybrid(spark, t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return rerank.rank_hybrid(_label_cands(t).join(docs, "id"), 0.7, 10)


@query(_CANDS + """,
    r AS (SELECT query_id, id, relevance AS score, (row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) - 1)::INT AS pos, id % 3 <> 0 AS e FROM c),
    g AS (SELECT query_id, list(score ORDER BY pos) AS s, list(e ORDER BY pos) AS e, list(pos ORDER BY pos) FILTER (NOT e) AS prim, list(pos ORDER BY pos) AS ord FROM r GROUP BY 1),
    w AS (
        SELECT query_id, s, e, prim, ord, 0 AS rank, 0 AS pt FROM g
        UNION ALL
        SELECT query_id, s, e, prim, CASE WHEN swap THEN list_transform(ord, lambda x, i: CASE i WHEN rank + 1 THEN ord[pp + 1] WHEN pp + 1 THEN ord[rank + 1] ELSE x END) ELSE ord END,
               rank + 1, CASE WHEN swap THEN pt2 + 1 ELSE pt2 END
        FROM (SELECT *, coalesce(e[ord[rank + 1] + 1] AND pp IS NOT NULL
                     AND NOT (s[ord[rank + 1] + 1] > 0 AND s[ord[pp + 1] + 1] > 0 AND s[ord[rank + 1] + 1] >= 1.2 * s[ord[pp + 1] + 1]), false) AS swap
              FROM (SELECT *, prim[pt2 + 1] AS pp FROM (
                        SELECT *, greatest(pt, len(list_filter(coalesce(prim, []), lambda x: x <= rank))) AS pt2 FROM w WHERE rank < least(10, len(ord)))))),
    o AS (SELECT query_id, arg_max(ord, rank) AS ord FROM w GROUP BY 1),
    t AS (SELECT query_id, unnest(ord) AS pos, unnest(range(1, len(ord) + 1))::INT AS rank FROM o)
    SELECT query_id, id, rank FROM t JOIN r USING (query_id, pos)""")
def displacement_guard(spark, t):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    rows = _label_cands(t).select("query_id", "id", F.col("relevance").alias("score"), (F.row_number().over(w) - 1).alias("pos"), (F.col("id") % 3 != 0).alias("is_expansion"))
    return rerank.displacement_guard(rows, 10, 1.2)


_INT8 = """
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM e),
    c AS (SELECT id, v, norm, list_transform(v, lambda x: greatest(-127, least(127, round(x * 127 / peak)))::DOUBLE) AS codes, peak / norm / 127 AS scale FROM n)"""


@query(_INT8 + " SELECT id, round(scale, 9) AS scale, list_sum(list_transform(codes, lambda x, i: x * i))::BIGINT AS code_sum FROM c")
def int8_quantize(spark, t):
    q = _vec(t).select("id", vectors.quantize_int8(F.col("v")).alias("q")).select("id", "q.*")
    total = F.aggregate(F.transform("codes", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("id", F.round("scale", 9).alias("scale"), total.alias("code_sum"))


_INT8_RANK = _INT8 + """,
    s AS (SELECT q.id AS query_id, c.id, scale * list_sum(list_transform(list_zip(codes, q.v), lambda z: z[1] * z[2])) / q.norm AS s
          FROM n q, c WHERE q.id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM s)"""


@query(_INT8_RANK + " SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def int8_search(spark, t):
    v = _vec(t)
    index = VectorIndex(_dim(v)).upsert(v)
    return index.search(v.filter(STATED), 10).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(_INT8_RANK.replace("WHERE q.id % 50 = 0", "WHERE q.id % 50 = 0 AND c.id % 3 = 1") + " SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def int8_search_allowed(spark, t):
    """Only allowed ids are searched; unknown ones among them are ignored."""
    v = _vec(t)
    allowed = v.filter("id % 3 = 1").select("id")
    allowed = allowed.unionByName(allowed.select((-F.col("id") - 1).alias("id")))
    return VectorIndex(_dim(v)).upsert(v).search(v.filter(STATED), 10, allowed).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


def _dim(v: DataFrame) -> int:
    return len(v.select("v").first()[0])


@query(_INT8_RANK + """,
    x AS (SELECT r.query_id, r.id, list_cosine_similarity(a.v, b.v) AS s FROM r JOIN e a ON a.id = r.query_id JOIN e b ON b.id = r.id WHERE rank <= 50),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM x)
    SELECT query_id, id, round(s, 6) AS score, rank FROM y WHERE rank <= 10""")
def int8_two_stage(spark, t):
    v = _vec(t)
    out = VectorIndex(_dim(v)).upsert(v).two_stage(v, v.filter(STATED), 10, 50)
    return out.select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(_INT8 + """
    SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE 1 END * list_sum(list_transform(codes, lambda x, i: x * i))::BIGINT AS code_sum
    FROM c WHERE id % 7 <> 0 UNION ALL
    SELECT id + 1000000, list_sum(list_transform(codes, lambda x, i: x * i))::BIGINT FROM c WHERE id % 11 = 0 AND (id + 1000000) % 7 <> 0""")
def index_upsert_remove(spark, t):
    """Replace every tenth vector by its negative, add new ids, remove every seventh id."""
    v = _vec(t)
    flipped = v.filter("id % 10 = 0").select("id", F.transform("v", lambda x: -x).alias("v"))
    added = v.filter("id % 11 = 0").select((F.col("id") + 1000000).alias("id"), "v")
    index = VectorIndex(_dim(v)).upsert(v).upsert(flipped.unionByName(added))
    every = index.rows.select("id").filter("id % 7 = 0")
    index, _ = index.remove(every)
    total = F.aggregate(F.transform("codes", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return index.rows.select("id", total.alias("code_sum"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s_]', ' ', 'g'), '\s+'), lambda x: x <> ''))"
_FUSED = _CANDS + f""",
    ts AS (SELECT doc_id AS id, {_TOKENS} AS a FROM documents),
    one AS (SELECT a AS b FROM ts WHERE id = (SELECT min(id) FROM ts)),
    lx AS (SELECT query_id, c.id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS s
           FROM c JOIN ts ON ts.id = c.id, one),
    al AS (SELECT query_id, id, relevance AS s, 'vector' AS source FROM c UNION ALL SELECT query_id, id, s, 'fts' FROM lx),
    nm AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM al WINDOW w AS (PARTITION BY query_id, source)),
    ct AS (SELECT query_id, id, source, (CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END) * (CASE source WHEN 'fts' THEN 0.4 ELSE 0.6 END) AS s FROM nm),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY s DESC, source) AS k FROM ct)"""


def _both_lists(t) -> DataFrame:
    """Per label its vectors by cosine to vector 0, and their documents by word
    overlap with the first document."""
    cands = _label_cands(t)
    near = cands.select("query_id", "id", F.col("relevance").alias("score"), F.lit("vector").alias("source"))
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    one = docs.orderBy("id").limit(1).select("text").collect()
    score = scoring.token_jaccard(F.col("text"), F.lit(one[0][0] if one else None))
    lexical = cands.select("query_id", "id").join(docs, "id").select("query_id", "id", score.alias("score"), F.lit("FTS").alias("source"))
    return near.unionByName(lexical)


@query(_FUSED + " SELECT query_id, id, round(s, 6) AS score, source FROM rk WHERE k = 1")
def fuse_ranks(spark, t):
    return fusion.fuse(_both_lists(t), 0.4, 0.6).select("query_id", "id", r6(F.col("score")).alias("score"), "source")


@query(_FUSED + ", fc AS (SELECT rk.query_id, rk.id, v, rk.s AS relevance FROM rk JOIN c ON c.id = rk.id WHERE k = 1)" + _mmr_sql(10, False, "fc"))
def fuse_then_mmr(spark, t):
    return fusion.fuse_then_mmr(_both_lists(t), _vec(t), 0.7, 10, 0.4, 0.6)


_INTENTS = "|".join(("find", "search", "list", "show", *text._EXPLAIN, *text._RECALL))
_WHEN = "|".join(("yesterday", "today", "tonight", "recently", "ago", "earlier", *(d.replace(" ", r"\s+") for d in text._DAYS)))
_ASKS = ", ".join(f"'{w}'" for w in text._ASK)
_ROUTE = rf"""
    WITH q AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts,
        lower(regexp_extract(text, '(?i)\b({_INTENTS})\b', 1)) AS i FROM conversations),
    s AS (SELECT conv_id, turn, len(ts)::INT AS token_count,
        regexp_matches(text, '(?i)\b({_WHEN})\b') AS has_recency,
        regexp_matches(text, '"[^"]+"|\b[A-Z][a-z]+(\s+[A-Z][a-z]+)+\b') AS has_entity,
        nullif(i, '') AS intent,
        regexp_matches(text, '\?\s*$') OR coalesce(lower(ts[1]) IN ({_ASKS}), false) AS is_question FROM q)"""


@query(_ROUTE + " SELECT * FROM s")
def route_signals(spark, t):
    return t("conversations").select("conv_id", "turn", text.route_signals(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query(_ROUTE + """,
    c AS (SELECT conv_id, turn, CASE WHEN has_entity THEN 3.0 ELSE 0 END::DOUBLE AS entity,
        (CASE WHEN token_count <= 3 THEN 2.0 ELSE 0 END + CASE WHEN NOT is_question THEN 1.0 ELSE 0 END)::DOUBLE AS lexical,
        (CASE WHEN is_question THEN 2.0 ELSE 0 END + CASE WHEN token_count >= 6 THEN 2.0 ELSE 0 END
         + CASE WHEN intent IN ('compare','explain','define','summarize','summarise') THEN 1.5
                WHEN intent IS NOT NULL AND intent NOT IN ('recall','remember') THEN 0.5 ELSE 0 END + 0.1)::DOUBLE AS semantic,
        (CASE WHEN has_recency THEN 3.0 ELSE 0 END + CASE WHEN intent IN ('recall','remember') THEN 1.0 ELSE 0 END)::DOUBLE AS temporal FROM s)
    SELECT conv_id, turn, CASE greatest(entity, lexical, semantic, temporal) WHEN entity THEN 'entity' WHEN lexical THEN 'lexical' WHEN semantic THEN 'semantic' ELSE 'temporal' END AS route,
        round(greatest(entity, lexical, semantic, temporal) / (entity + lexical + semantic + temporal), 6) AS confidence,
        round(entity, 6) AS entity, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(temporal, 6) AS temporal FROM c""")
def route_decide(spark, t):
    rows = t("conversations").select("conv_id", "turn", text.route_signals(F.col("text")).alias("s")).select("conv_id", "turn", text.decide_route(F.col("s")).alias("d"))
    return rows.select("conv_id", "turn", "d.route", *[r6(F.col(f"d.{c}")).alias(c) for c in ("confidence", *text.ROUTES)])


_FTS = r"""
    WITH q AS (SELECT conv_id, turn, text AS q FROM conversations),
    s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(left(q, 500), '\b(OR|AND|NOT|NEAR)\b', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS sane FROM q),
    c AS (SELECT *, regexp_replace(translate(lower(sane), '?!:.,;/"''', '         '), '^\s+|\s+$', '', 'g') AS clean FROM s)"""


@query(_FTS + " SELECT conv_id, turn, sane, clean AS searchable FROM c")
def fts_sanitize(spark, t):
    sane = text.sanitize_fts(F.col("text"))
    return t("conversations").select("conv_id", "turn", sane.alias("sane"), text.strip(text.sanitize_for_searchable(sane)).alias("searchable"))


@query(_FTS + r""",
    k AS (SELECT *, regexp_split_to_array(clean, '\s+') AS ts, (starts_with(q, '"') AND ends_with(q, '"')) OR (starts_with(q, '''') AND ends_with(q, '''')) AS quoted FROM c)
    SELECT conv_id, turn, CASE WHEN quoted THEN '"' || replace(CASE WHEN length(q) <= 1 THEN '' ELSE q[2:-2] END, '"', '""') || '"' WHEN clean = '' THEN ''
        WHEN len(ts) > 1 THEN array_to_string(ts, ' OR ') WHEN regexp_full_match(clean, '[\p{L}\p{M}\p{N}]+') THEN clean || '*' ELSE clean END AS match,
        quoted OR clean <> '' AS ok FROM k""")
def fts_compile(spark, t):
    c = text.compile_fts_query(F.col("text"))
    return t("conversations").select("conv_id", "turn", c["match"].alias("match"), c["ok"].alias("ok"))


@query(r"""
    WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    p AS (SELECT id, len(ts) AS dl, unnest(ts) AS t FROM d),
    tf AS (SELECT id, dl, t, count(*) AS tf FROM p GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark WHERE item_id % 50 = 0),
    s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
          FROM q JOIN tf USING (t) JOIN df USING (t), st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM s)
    SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 20""")
def bm25_topk(spark, t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    items = t("benchmark").select(F.col("item_id").alias("id"), "text").filter(STATED)
    return bm25.bm25_top_k(docs, items, 20).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(r"""
    WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ts FROM documents)
    SELECT id, contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ') AS phrase, list_has_any(ts, ['der', 'les']) AS either,
           len(list_filter(ts, lambda x: starts_with(x, 'then'))) > 0 AS prefix, list_has_all(ts, ['and', 'with']) AS every FROM d""")
def fts_match(spark, t):
    m = lambda q: F.coalesce(bm25.matches(F.col("text"), q), F.lit(False))
    return t("documents").select(F.col("doc_id").alias("id"), m('"of the"').alias("phrase"), m("der OR les").alias("either"), m("then*").alias("prefix"), m("and with").alias("every"))


_EMAIL, _PHONE, _SSN = (p.removeprefix("(?U)") for p in redaction.GROUPS["pii"])


@query(rf"""
    WITH a AS (SELECT doc_id AS id, text AS t0, regexp_replace(text, '{_EMAIL}', '[REDACTED:pii]', 'g') AS t1 FROM documents),
    b AS (SELECT *, regexp_replace(t1, '{_PHONE}', '[REDACTED:pii]', 'g') AS t2 FROM a),
    c AS (SELECT *, regexp_replace(t2, '{_SSN}', '[REDACTED:pii]', 'g') AS t3,
        len(regexp_extract_all(t0, '{_EMAIL}')) + len(regexp_extract_all(t1, '{_PHONE}')) + len(regexp_extract_all(t2, '{_SSN}')) AS n FROM b)
    SELECT id, sha256(t3) AS content_sha256, n::INT AS match_count, CASE WHEN n > 0 THEN 'pii' ELSE '' END AS groups FROM c""")
def redact_pii(spark, t):
    out = redaction.scrub(t("documents"), "text", redaction.RedactionConfig(patterns=("pii",), redact_pii=True))
    return out.select(F.col("doc_id").alias("id"), F.sha2("content", 256).alias("content_sha256"), "match_count", F.array_join("groups_fired", ",").alias("groups"))


def _scrub_sql() -> str:
    """Pattern after pattern over what the ones before have left."""
    steps, k = [], 0
    for group in redaction.ORDER:
        for p in redaction.GROUPS.get(group, ()):
            p = p.replace("(?iU)", "(?i)").removeprefix("(?U)").replace("'", "''")
            steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (t), regexp_replace(t, '{p}', '[REDACTED:{group}]', 'g') AS t, len(regexp_extract_all(t, '{p}')) AS n_{group}_{k} FROM s{k})")
            k += 1
    of = {g: " + ".join(f"n_{g}_{i}" for i, h in enumerate(h for h in redaction.ORDER for _ in redaction.GROUPS.get(h, ())) if h == g) for g in redaction.ORDER if g in redaction.GROUPS}
    names = ", ".join(f"CASE WHEN {n} > 0 THEN '{g}' END" for g, n in of.items())
    return ", ".join(steps) + f" SELECT id, ({' + '.join(of.values())})::INT AS match_count, concat_ws(',', {names}) AS groups, sha256(t) AS content_sha256 FROM s{k}"


_FILL = "Ab1" * 20


@query(f"WITH s0 AS (SELECT doc_id AS id, concat_ws(' ', text, 'sk-{_FILL[:30]}', 'ghp_{_FILL[:36]}', 'AKIA{'Q7' * 8}', 'Bearer {_FILL[:30]}') AS t FROM documents), " + _scrub_sql())
def redact_secrets(spark, t):
    """All built-in groups over all texts, one key of each planted in the text by
    the query itself, since the tables hold none."""
    fill = lambda p, n: F.lit(p + ("Ab1" * 20)[:n])
    planted = F.concat_ws(" ", "text", fill("sk-", 30), fill("ghp_", 36), F.lit("AKIA" + "Q7" * 8), fill("Bearer ", 30))
    config = redaction.RedactionConfig(patterns=tuple(redaction.GROUPS), redact_pii=True)
    out = redaction.scrub(t("documents").withColumn("text", planted), "text", config)
    return out.select(F.col("doc_id").alias("id"), "match_count", F.array_join("groups_fired", ",").alias("groups"), F.sha2("content", 256).alias("content_sha256"))


def _edges(t) -> DataFrame:
    e = lambda df, a, b, k: df.select(F.concat(F.lit(a[0]), F.col(a[1:])).alias("src"), F.concat(F.lit(b[0]), F.col(b[1:])).alias("dst"), F.lit(k).alias("kind"), F.lit(1.0).alias("weight"))
    return (
        e(t("nation"), "rn_regionkey", "nn_nationkey", "has")
        .unionByName(e(t("customer"), "nc_nationkey", "cc_custkey", "home"))
        .unionByName(e(t("orders"), "co_custkey", "oo_orderkey", "placed"))
        .unionByName(e(t("supplier"), "ss_suppkey", "ns_nationkey", "from"))
    )


_GRAPH = """
    WITH RECURSIVE edges AS (
        SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    starts AS (SELECT 's' || s_suppkey AS id, s_suppkey FROM supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region),
    w AS (SELECT id AS start, id, 0 AS hop FROM starts WHERE id IN (SELECT src FROM edges)
        UNION SELECT w.start, e.dst, w.hop + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.hop < 3),
    h AS (SELECT start, id, min(hop) AS hop FROM w GROUP BY 1, 2)"""


def _starts(t) -> DataFrame:
    s = t("supplier").filter("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return s.unionByName(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")))


@query(_GRAPH + " SELECT start, id, hop FROM h")
def graph_khop(spark, t):
    return graph.Graph(_edges(t)).neighbors_within(_starts(t), 3)


@query(_GRAPH + """ SELECT start AS src, id AS dst, hop + 1 AS path_nodes FROM h WHERE id LIKE 'c%'""")
def graph_shortest_path(spark, t):
    customers = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("dst"), F.concat(F.lit("n"), "c_nationkey").alias("n"))
    # every pair of a start and a customer of a nation it leads to
    first = graph.Graph(_edges(t)).neighbors_within(_starts(t), 1).select(F.col("start").alias("src"), F.col("id").alias("n"))
    pairs = first.join(customers, "n").select("src", "dst")
    return graph.Graph(_edges(t)).shortest_path(pairs, 3).select("src", "dst", F.size("path").alias("path_nodes"))


@query(_GRAPH.replace("hop < 3", "hop < 2") + """,
    o AS (SELECT id, row_number() OVER (ORDER BY id) AS seed_ord FROM starts),
    b AS (SELECT h.id, min({'a': seed_ord, 'h': hop}) AS m FROM h JOIN o ON h.start = o.id WHERE h.id NOT IN (SELECT id FROM starts) GROUP BY 1)
    SELECT id, m.a AS seed_ord, m.h AS hop FROM b ORDER BY 2, 3, 1 LIMIT 100""")
def graph_expand(spark, t):
    """The limit is the operator's own."""
    from pyspark.sql import Window

    seeds = _starts(t).withColumn("seed_ord", F.row_number().over(Window.orderBy("id")))
    return graph.Graph(_edges(t)).expand(seeds, 2, 100)


@query("SELECT doc_id AS id, sha256(text) AS digest FROM documents")
def content_hash(spark, t):
    return t("documents").select(F.col("doc_id").alias("id"), text.sha256_hex(F.col("text")).alias("digest"))


@query("""
    SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change
    FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 7 = 0 AND doc_id % 5 <> 0 OR doc_id % 11 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def hash_diff(spark, t):
    """Two snapshots of the documents: some are new, some gone, some edited."""
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    old = d.filter("id % 5 <> 0").select("id", F.sha2("text", 256).alias("sha256"))
    edited = F.when(F.col("id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.filter("id % 7 <> 0").select("id", F.sha2(edited, 256).alias("sha256"))
    return files.snapshot_diff(old, new, "id")


_TOK = "SELECT doc_id AS id, (greatest(strlen(text) // 3, length(text)) + 2)::BIGINT AS tokens FROM documents"


@query(_TOK)
def estimate_tokens(spark, t):
    return t("documents").select(F.col("doc_id").alias("id"), text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH t AS ({_TOK}) SELECT CASE WHEN tokens <= 64 THEN 0 WHEN tokens <= 256 THEN 1 WHEN tokens <= 1024 THEN 2 ELSE 3 END AS bucket,
    count(*) AS n, sum(tokens)::BIGINT AS tokens FROM t GROUP BY 1""")
def length_buckets(spark, t):
    rows = t("documents").select(text.estimate_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy(text.length_bucket(F.col("tokens")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"""
    WITH RECURSIVE k AS ({_TOK}),
    j AS (SELECT source AS bucket, id AS seq, tokens, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM k JOIN documents ON doc_id = id),
    p AS (
        SELECT bucket, seq, tokens, n, 0 AS batch, tokens AS used FROM j WHERE n = 1
        UNION ALL
        SELECT j.bucket, j.seq, j.tokens, j.n, batch + (used + j.tokens > 8192)::INT, CASE WHEN used + j.tokens > 8192 THEN j.tokens ELSE used + j.tokens END
        FROM p JOIN j ON j.bucket = p.bucket AND j.n = p.n + 1)
    SELECT bucket, seq, tokens, batch FROM p""")
def pack_batches(spark, t):
    rows = t("documents").select(F.col("source").alias("bucket"), F.col("doc_id").alias("seq"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return tokens.pack_batches(rows, 8192)


@query("""
    WITH RECURSIVE j AS (
        SELECT user_id AS queue, event_id AS seq, epoch(ts) AS ts_s, trunc(value * 10 + 1)::INT AS tokens, CASE WHEN event_type = 'error' THEN epoch(ts) + 60 END AS deadline,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (
        SELECT queue, n, seq, 0 AS flush, ts_s AS opened, tokens AS total, false AS drained, ts_s AS now FROM j WHERE n = 1
        UNION ALL
        SELECT queue, n, seq, flush, opened, total, NOT first AND total >= 2048, ts_s FROM (
            SELECT j.queue, j.n, j.seq, j.ts_s, w.drained OR j.ts_s >= w.opened + 3600 AS first, w.flush + (w.drained OR j.ts_s >= w.opened + 3600)::INT AS flush,
                   CASE WHEN w.drained OR j.ts_s >= w.opened + 3600 THEN j.ts_s ELSE w.opened END AS opened,
                   CASE WHEN w.drained OR j.ts_s >= w.opened + 3600 THEN 0 ELSE w.total END + j.tokens AS total
            FROM w JOIN j ON j.queue = w.queue AND j.n = w.n + 1)),
    f AS (SELECT queue, flush, coalesce(max(now) FILTER (drained), max(opened) + 3600) AS flushed_at FROM w GROUP BY 1, 2),
    o AS (SELECT w.queue, w.seq, w.flush, j.tokens, j.deadline, CASE WHEN tokens <= 64 THEN 0 WHEN tokens <= 256 THEN 1 WHEN tokens <= 1024 THEN 2 ELSE 3 END AS bucket, w.n FROM w JOIN j USING (queue, n)),
    r AS (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY bucket, n) AS k FROM o),
    b AS (
        SELECT queue, flush, k, seq, bucket, deadline, 0 AS batch, tokens AS used FROM r WHERE k = 1
        UNION ALL
        SELECT r.queue, r.flush, r.k, r.seq, r.bucket, r.deadline, batch + (r.bucket <> b.bucket OR used + r.tokens > 2048)::INT,
               CASE WHEN r.bucket <> b.bucket OR used + r.tokens > 2048 THEN r.tokens ELSE used + r.tokens END
        FROM b JOIN r ON r.queue = b.queue AND r.flush = b.flush AND r.k = b.k + 1)
    SELECT queue, seq, flush, flushed_at, bucket, batch, coalesce(flushed_at >= deadline, false) AS expired FROM b JOIN f USING (queue, flush)""")
def coalesce_jobs(spark, t):
    """Every event is a job of its user's queue; windows of an hour, caps of 2,048 tokens."""
    at = F.col("ts").cast("timestamp").cast("double")
    jobs = t("events").select(
        F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), at.alias("at"), (F.col("value") * 10 + 1).cast("int").alias("tokens"),
        F.when(F.col("event_type") == "error", at + 60).alias("deadline"),
    )
    return dispatcher.coalesce(jobs, dispatcher.DispatcherConfig(window_ms=3_600_000))


@query("""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
    w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 510 THEN 1 ELSE 1 + ceil((n - 510) / 448.0)::INT END))::INT AS "window" FROM d)
    SELECT doc_id, "window", ("window" * 448)::INT AS start, least(n, "window" * 448 + 510)::INT AS "end" FROM w""")
def plan_windows(spark, t):
    return tokens.token_windows(t("documents").select("doc_id", "text"), "text", 512, 64)


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, count(*) AS n FROM r WHERE n <= 1024 GROUP BY 1""")
def latency_percentiles(spark, t):
    return tokens.latency_percentiles(t("events"), "event_type", ["ts", "event_id"], "value")


@query()
def embed_hash(spark, t):
    out = models.embed(t("documents"), "doc_id", "text", models.HashingBackend(32))
    return out.select("id", F.size("v").alias("dim"), r6(vectors.norm(F.col("v"))).alias("norm"), "error")


@query("""
    WITH RECURSIVE g AS (SELECT doc_id AS id, unnest(range(0, 24)) AS i FROM documents),
    c AS (SELECT id, (i // 6)::INT AS start, (i // 6 + (i // 2) % 3 + 1)::INT AS "end", (i % 2)::INT AS label, ((id * 7919 + i * 104729 + i * i * 31) % 1000) / 1000.0::DOUBLE AS score FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, "end", label) AS n FROM c WHERE score >= 0.5),
    t AS (
        SELECT id, n, [{'a': start, 'b': "end", 'l': label, 's': score}] AS taken FROM k WHERE n = 1
        UNION ALL
        SELECT k.id, k.n, CASE WHEN len(list_filter(taken, lambda x: x.a < k."end" AND k.start < x.b)) > 0 THEN taken
                               ELSE list_append(taken, {'a': k.start, 'b': k."end", 'l': k.label, 's': k.score}) END
        FROM t JOIN k ON k.id = t.id AND k.n = t.n + 1),
    z AS (SELECT id, unnest(arg_max(taken, n)) AS x FROM t GROUP BY 1)
    SELECT id, x.a AS start, x.b AS "end", x.l AS label, round(x.s, 6) AS score FROM z""")
def decode_spans(spark, t):
    """Scores of four starts, three widths and two labels, made from each id."""
    i = F.sequence(F.lit(0), F.lit(23))
    scores = F.transform(i, lambda i: F.pmod(F.col("doc_id") * 7919 + i * 104729 + i * i * 31, F.lit(1000)) / 1000.0)
    rows = t("documents").select(F.col("doc_id").alias("id"), scores.alias("scores"), F.lit(4).alias("max_spans"), F.lit(3).alias("width"), F.lit(2).alias("labels"))
    return models.decode_spans(rows, 0.5).select("id", "start", "end", "label", r6(F.col("score")).alias("score"))


@query("""
    WITH e AS (SELECT event_id AS id, value AS load, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0)::DOUBLE AS elapsed FROM events)
    SELECT id, CASE WHEN load >= 90 THEN 'HALTED' WHEN load >= 70 THEN 'THROTTLED' WHEN elapsed < 30 THEN 'HALTED' WHEN elapsed < 60 THEN 'TAPERED' ELSE 'CONTINUOUS' END AS mode,
        (CASE WHEN load >= 90 THEN NULL WHEN load >= 70 THEN 10 WHEN elapsed < 30 THEN NULL WHEN elapsed < 60 THEN 5 ELSE 0.1 END)::DOUBLE AS background_delay,
        (CASE WHEN load >= 90 THEN 30 ELSE 0 END)::DOUBLE AS interactive_delay FROM e""")
def governor_pacing(spark, t):
    from pyspark.sql import Window

    ts = F.col("ts").cast("timestamp").cast("double")
    lag = F.lag(ts).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t("events").select(F.col("event_id").alias("id"), F.col("value").alias("load"), F.coalesce(ts - lag, F.lit(0.0)).alias("elapsed"))
    return rows.select("id", control.decide_pacing(F.col("load"), F.col("elapsed")).alias("p")).select("id", "p.*")


@query("""SELECT l_orderkey, l_linenumber, round(least(2.0, 0.1 * pow(2.0, least(greatest(l_linenumber - 1, 0), 31))), 6) AS delay FROM lineitem""")
def retry_backoff(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(control.retry_delay(F.col("l_linenumber"))).alias("delay"))


@query("""
    WITH RECURSIVE c AS (
        SELECT user_id AS key, event_id AS seq, epoch(ts) AS ts_s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (
        SELECT key, n, seq, true AS admitted, 'closed' AS phase, 0.0::DOUBLE AS since, CASE WHEN ok THEN 0 ELSE 1 END AS failures, ts_s FROM c WHERE n = 1
        UNION ALL
        SELECT key, n, seq, adm, CASE WHEN NOT adm THEN phase WHEN ok THEN 'closed' WHEN fails >= 2 OR phase <> 'closed' THEN 'open' ELSE 'closed' END,
               CASE WHEN adm AND (phase <> 'closed' OR NOT ok AND fails >= 2) THEN ts_s ELSE since END, fails, ts_s
        FROM (SELECT *, CASE WHEN NOT adm THEN failures WHEN ok THEN 0 ELSE failures + 1 END AS fails
              FROM (SELECT c.key, c.n, c.seq, c.ts_s, c.ok, w.phase, w.since, w.failures, w.phase = 'closed' OR 86400 - greatest(0, c.ts_s - w.since) <= 0 AS adm
                    FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1)))
    SELECT key, seq, admitted, CASE WHEN phase = 'closed' THEN 'closed' WHEN 86400 - greatest(0, ts_s - since) > 0 THEN 'open' ELSE 'half_open' END AS state, failures FROM w""")
def breaker_replay(spark, t):
    calls = t("events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok")
    )
    return control.replay_breaker(calls, 2, 86400.0)


@query("""SELECT event_id AS id, 'event | ' || event_type || ' | user=' || user_id AS line FROM events""")
def format_log(spark, t):
    return t("events").select(F.col("event_id").alias("id"), text.format_log(F.lit("event"), F.col("event_type"), F.lit(None), F.lit(""), user=F.col("user_id")).alias("line"))


def _rings(t) -> DataFrame:
    """Every event rings event_type@user; readers are each type and the stated users."""
    return t("events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.concat_ws("@", "event_type", "user_id").alias("recipient"), F.col("event_type").alias("origin")
    )


def _readers(t) -> DataFrame:
    e = t("events")
    return e.select(F.col("event_type").alias("reader")).unionByName(e.filter("user_id % 50 = 0").select(F.concat_ws("@", "event_type", "user_id").alias("reader"))).distinct()


_DOOR = """
    WITH g AS (SELECT event_id AS seq, epoch(ts) AS secs, event_type || '@' || user_id AS recipient, event_type, user_id FROM events),
    v AS (SELECT DISTINCT event_type AS reader FROM events UNION SELECT DISTINCT event_type || '@' || user_id FROM events WHERE user_id % 50 = 0),
    s AS (SELECT v.reader, g.seq, g.secs FROM g JOIN v ON v.reader = g.recipient OR (v.reader NOT LIKE '%@_%' AND starts_with(g.recipient, v.reader || '@')))"""


@query(_DOOR + " SELECT reader, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM s GROUP BY 1")
def doorbell_sees(spark, t):
    seen = doorbell.sees_join(_rings(t), _readers(t))
    return seen.groupBy("reader").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(_DOOR + """, m AS (SELECT max(secs) AS now FROM g)
    SELECT v.reader AS key, count(s.seq) AS pending, round(max(now) - min(s.secs), 3) AS oldest_pending_s
    FROM v LEFT JOIN s ON s.reader = v.reader AND s.seq > 500, m GROUP BY 1""")
def doorbell_status(spark, t):
    now = _rings(t).agg(F.max("at")).collect()[0][0]
    out = doorbell.status(_rings(t), _readers(t).select(F.col("reader").alias("key"), F.lit(500).alias("cursor")), now)
    return out.select("key", "pending", F.round("oldest_pending_s", 3).alias("oldest_pending_s"))


@query()
def doorbell_wakes(spark, t):
    """Every reader waits at each of its hours of the log."""
    first, last = _rings(t).agg(F.min("at"), F.max("at")).collect()[0]
    n_hours = 0 if first is None else int((last - first) // 3600) + 1
    hours = spark.range(n_hours).select((F.lit(first).cast("double") + F.col("id") * 3600.0 - 1).alias("at"))
    each = hours.crossJoin(_readers(t))
    waits = each.select("at", F.array("reader").alias("readers"), F.lit(7200.0).alias("timeout_s"))
    out = doorbell.replay(_rings(t), waits, window=60.0, keep=86400.0)
    return out.select("key", "since", "at", "wake", "count", F.size("recipients").alias("n_recipients"), F.array_join("origins", ",").alias("origins"))


@query()
def file_walk_hash(spark, t):
    """Every stored file of the events table, hashed where Spark reads it."""
    globs = t("events").inputFiles()
    found = files.hash_stored(spark, globs)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, t):
    """Hourly counts by a streaming aggregation over the stored events."""
    files_ = t("events").inputFiles()
    return stream_hourly(spark, files_[0].rsplit("/", 1)[0] if len(files_) > 1 or files_[0].rsplit("/", 2)[1].endswith(".parquet") else files_[0], t("events").schema)


def stream_hourly(spark: SparkSession, path: str, schema) -> DataFrame:
    import uuid

    folder, _, name = path.rpartition("/")
    src = spark.readStream.schema(schema)
    rows = src.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else src.parquet(path)
    ts = F.col("ts").cast("timestamp")
    agg = rows.withColumn("ts", ts).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    agg = agg.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    view = f"hourly_{uuid.uuid4().hex}"
    q = agg.writeStream.outputMode("complete").format("memory").queryName(view).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(view).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(r"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    tf AS (SELECT id, dl, t, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (SELECT DISTINCT id AS query_id, unnest(ts) AS t FROM d JOIN embeddings ON vec_id = id WHERE id % 50 = 0),
    sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS s
           FROM q JOIN tf USING (t) JOIN df USING (t), st GROUP BY 1, 2),
    lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sc),
    e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    ns AS (SELECT a.id AS query_id, e.id, round(greatest(-1.0, least(1.0, list_cosine_similarity(a.v, e.v))), 12) AS s FROM e a JOIN d ON d.id = a.id, e WHERE a.id % 50 = 0),
    nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ns),
    al AS (SELECT query_id, id, s, 'fts' AS source FROM lx WHERE rank <= 100 UNION ALL SELECT query_id, id, s, 'vector' FROM nr WHERE rank <= 100),
    nm AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM al WINDOW w AS (PARTITION BY query_id, source)),
    fu AS (SELECT query_id, id, max(0.5 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END) AS relevance FROM nm GROUP BY 1, 2),
    bd AS (SELECT fu.*, v, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM fu JOIN documents ON doc_id = fu.id JOIN e ON e.id = fu.id),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY relevance DESC, id) AS dup FROM bd),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM u WHERE dup = 1 OR body = ''),
    h AS (SELECT query_id, id, v, relevance FROM b WHERE n <= 30)""" + _mmr_sql(10, True, "h"))
def hybrid_pipeline(spark, t):
    """Lexical and vector candidates of each stated document, fused and reranked."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    queries = docs.join(_vec(t), "id").filter(STATED)
    return hybrid_search(docs, _vec(t), queries, 10)
