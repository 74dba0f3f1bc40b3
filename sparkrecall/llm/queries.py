"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, langid, line_dedup, quality, secrets, simhash, warc, wrapper
from .common import table


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit(F.col("runs"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *(secrets.n_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("parts")).alias("spans"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_attention_mil": op2_attention_mil,
    "op3_wu_manber": op3_wu_manber,
    "op4_hyperdimensional": op4_hyperdimensional,
    "op5_line_chunks": op5_line_chunks,
    "op6_word_bpe": op6_word_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_secret_links": op9_secret_links,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_wu_manber": r"""
        WITH w AS (
            SELECT 'd' AS side, row_number() OVER () AS row_no, doc_id AS id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
            UNION ALL
            SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        p AS (
            SELECT id AS item_id, least(len(ws), 10) AS n,
                   unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win
            FROM w WHERE side = 'b' AND len(ws) > 0),
        l AS (SELECT DISTINCT n FROM p),
        dw AS (
            SELECT row_no, n, unnest(range(1, len(ws) - n + 2)) AS pos,
                   unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS win
            FROM w, l WHERE side = 'd' AND len(ws) >= n),
        h AS (SELECT dw.row_no, dw.pos, dw.n, p.item_id FROM dw JOIN p ON dw.win = p.win AND dw.n = p.n),
        c AS (SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT row_no, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY 1),
        i AS (SELECT row_no, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
              FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS s FROM h) GROUP BY 1)
        SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN c USING (row_no) LEFT JOIN i USING (row_no) WHERE side = 'd'""",
    "op5_line_chunks": r"""
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (
            SELECT row_no, doc_id, k - 1 AS k, ls[k] AS line, ('0x' || left(md5(ls[k]), 8))::BIGINT AS h,
                   len(list_filter(string_split(ls[k], ' '), lambda w: w <> '')) >= 50 AS long
            FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM d)),
        b AS (
            SELECT *, coalesce(lag(stop) OVER w, true) AS opens FROM (
                SELECT *, long OR coalesce(lead(long) OVER w, true)
                          OR (h + 31 * coalesce(lag(h) OVER w, 0)) % 4 = 0 AS stop
                FROM l WINDOW w AS (PARTITION BY row_no ORDER BY k))
            WINDOW w AS (PARTITION BY row_no ORDER BY k)),
        c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row_no ORDER BY k) AS c FROM b),
        g AS (
            SELECT row_no, doc_id, c, min(k) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS chunk
            FROM c GROUP BY row_no, doc_id, c HAVING count(*) > 1 OR bool_or(long)),
        r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, row_no, start) AS place FROM g),
        x AS (SELECT row_no, start, n FROM r WHERE place > 1),
        m AS (SELECT row_no, unnest(range(start, start + n)) AS k FROM x),
        t AS (
            SELECT l.row_no, count(*) AS n_lines, count(m.k) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (m.k IS NULL), '') AS text
            FROM l LEFT JOIN m ON l.row_no = m.row_no AND l.k = m.k GROUP BY l.row_no)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, t.text
        FROM d LEFT JOIN t USING (row_no)""",
    "op8_warc": r"""
        WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM r)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM g""",
    "op7_exact_dedup": r"""
        WITH r AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
                   row_number() OVER () AS row_no
            FROM documents),
        o AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER w AS n
            FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST, row_no))
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM o""",
}
