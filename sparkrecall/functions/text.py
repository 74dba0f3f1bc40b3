"""Query text: sanitising, full-text compilation, routing; token estimates; log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize_fts(q: Column, max_len: int = 500) -> Column:
    cut = F.substring(q, 1, max_len)
    plain = F.regexp_replace(cut, r"(?U)\b(?:OR|AND|NOT|NEAR)\b", " ")
    return strip(F.regexp_replace(plain, r"(?U)[^\w\s]", " "))


def sanitize_for_searchable(t: Column) -> Column:
    return F.translate(F.lower(t), "?!:.,;/\"'", " " * 9)


def is_alnum(t: Column) -> Column:
    return t.rlike(r"^[\p{IsAlphabetic}\p{N}]+$")


def compile_fts_query(q: Column, mode: str = "fts5") -> Column:
    """struct(match, ok): a phrase in quotes, an OR list, a prefix or the text."""
    quoted = (q.startswith('"') & q.endswith('"')) | (q.startswith("'") & q.endswith("'"))
    inner = F.when(F.length(q) <= 1, "").otherwise(F.substring(q, F.lit(2), F.greatest(F.length(q) - 2, F.lit(0))))
    phrase = F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('""')), F.lit('"'))

    def compiled(clean: Column) -> Column:
        one = F.concat(clean, F.lit("*"))
        if mode == "fts5":
            tokens = F.split(clean, r"(?U)\s+")
            plain = F.when(F.size(tokens) > 1, F.array_join(tokens, " OR ")).when(is_alnum(clean), one).otherwise(clean)
        else:
            plain = F.when(~clean.contains(" ") & is_alnum(clean), one).otherwise(clean)
        return F.struct(F.when(quoted, phrase).when(clean == "", "").otherwise(plain).alias("match"), (quoted | (clean != "")).alias("ok"))

    return let(strip(sanitize_for_searchable(sanitize_fts(q))), compiled)


def _any(*words: str) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


_DAYS = [f"last {x}" for x in ("week", "month", "year", "night")] + [f"this {x}" for x in ("week", "month", "morning")]
_RECENCY = r"(?iU)\b" + _any("yesterday", "today", "tonight", "recently", "ago", "earlier", *_DAYS) + r"\b"
_CAP = "[A-Z][a-z]+"
_ENTITY = rf"(?U)\"[^\"]+\"|\b{_CAP}(?:\s+{_CAP})+\b"
_EXPLAIN = ("compare", "explain", "define", "summarize", "summarise")
_RECALL = ("recall", "remember")
_INTENT = r"(?iU)\b(" + _any("find", "search", "list", "show", *_EXPLAIN, *_RECALL) + r")\b"
_ASK = "who what when where why how which did is are was were".split()


def route_signals(q: Column) -> Column:
    """struct(token_count, has_recency, has_entity, intent, is_question)."""
    tokens = F.filter(F.split(q, r"(?U)\s+"), lambda t: t != "")
    intent = F.lower(F.regexp_extract(q, _INTENT, 1))
    first = F.lower(F.get(tokens, 0))
    question = q.rlike(r"(?U)\?\s*$") | F.coalesce(first.isin(_ASK), F.lit(False))
    return F.struct(
        F.size(tokens).alias("token_count"),
        q.rlike(_RECENCY).alias("has_recency"),
        q.rlike(_ENTITY).alias("has_entity"),
        F.nullif(intent, F.lit("")).alias("intent"),
        question.alias("is_question"),
    )


ROUTES = ("entity", "lexical", "semantic", "temporal")


def decide_route(signals: Column) -> Column:
    """struct(route, confidence, entity, lexical, semantic, temporal)."""
    return let(let(signals, _route_scores), _best_route)


def _route_scores(signals: Column) -> Column:
    pick = lambda cond, yes: F.when(cond, F.lit(float(yes))).otherwise(0.0)
    n, intent, ask = signals["token_count"], signals["intent"], signals["is_question"]
    has = intent.isNotNull()
    recall = F.coalesce(intent.isin(*_RECALL), F.lit(False))
    explain = F.coalesce(intent.isin(*_EXPLAIN), F.lit(False))
    return F.struct(
        pick(signals["has_entity"], 3).alias("entity"),
        (pick(n <= 3, 2) + pick(~ask, 1)).alias("lexical"),
        (pick(ask, 2) + pick(n >= 6, 2) + pick(explain, 1.5) + pick(has & ~recall & ~explain, 0.5) + 0.1).alias("semantic"),
        (pick(signals["has_recency"], 3) + pick(recall, 1)).alias("temporal"),
    )


def _best_route(scores: Column) -> Column:
    best = F.array_max(F.array(*[F.struct(scores[r].alias("s"), F.lit(-k).alias("o"), F.lit(r).alias("r")) for k, r in enumerate(ROUTES)]))
    total = scores["entity"] + scores["lexical"] + scores["semantic"] + scores["temporal"]
    return F.struct(best["r"].alias("route"), (best["s"] / total).alias("confidence"), *[scores[r].alias(r) for r in ROUTES])


def estimate_tokens(t: Column) -> Column:
    """The larger of a third of the bytes and the characters, plus two for the frame."""
    return F.greatest(F.floor(F.octet_length(t) / 3), F.length(t).cast("long")) + 2


BUCKETS = (64, 256, 1024, 4096)


def length_bucket(n: Column, ceilings: tuple[int, ...] = BUCKETS) -> Column:
    out = F.lit(len(ceilings) - 1)
    for k in range(len(ceilings) - 2, -1, -1):
        out = F.when(n <= ceilings[k], k).otherwise(out)
    return out


def format_log(event: Column, *args: Column, **kw: Column) -> Column:
    """``event | a | k=v``; nulls and empty positional values are skipped."""
    parts = [F.nullif(a.cast("string"), F.lit("")) for a in args] + [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in kw.items()]
    return F.concat_ws(" | ", event, *parts)


def sha256_hex(t: Column) -> Column:
    return F.sha2(t, 256)


def hash_provider() -> str:
    """What computes digests: the security provider of the JVM."""
    return "jvm"
