"""Ordered secret and PII redaction with counts, as a chain of projections."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ALNUM = "0-9a-zA-Z"
_URL = f"[{_ALNUM}_-]"
_BEARER = rf"bearer\s+[{_ALNUM}+./=_~-]{{20,}}"
_GAP = r"[=:\s'\"]"


def _name(*words: str) -> str:
    return "[-_]?".join(words)


GROUPS: dict[str, list[str]] = {
    "api_keys": [f"sk-ant-{_URL}{{20,}}", f"sk-proj-{_URL}{{20,}}", f"sk-[{_ALNUM}]{{20,}}", f"xai-{_URL}{{20,}}", f"AIza{_URL}{{35}}"],
    "bearer_tokens": [rf"(?iU)authorization:\s*{_BEARER}", rf"(?iU)\b{_BEARER}"],
    "jwt": [rf"eyJ{_URL}{{10,}}\.eyJ{_URL}{{10,}}\.{_URL}{{10,}}"],
    "aws_keys": [
        "A[KS]IA[A-Z0-9]{16}",
        f"(?iU){_name('aws', 'secret', 'access', 'key')}{_GAP}+[{_ALNUM}+/=]{{40}}",
        f"(?iU)(?:x-amz-security-token|{_name('aws', 'session', 'token')}){_GAP}*[{_ALNUM}%+/=_-]{{40,}}",
        f"(?iU)(?:x-amz-)?signature{_GAP}*[{_ALNUM}%+/=]{{16,}}",
    ],
    "github_tokens": [f"gh{c}_[{_ALNUM}]{{36}}" for c in "pousr"],
    "pii": [
        f"[{_ALNUM}%+._-]+@[{_ALNUM}.-]+\\.[a-zA-Z]{{2,}}",
        r"(?U)\b(?:[+]?1[\s.-]?)?[(]?\d{3}[)]?[\s.-]?\d{3}[\s.-]?\d{4}\b",
        r"(?U)\b\d\d\d-\d\d-\d{4}\b",
    ],
}
#: What a match of a built-in pattern contains: one of these, in small letters if
#: the pattern knows no case. Only what has them is searched. No i, k or s stands in
#: the latter, since other letters than I, K and S match those.
PARTS: dict[str, tuple[str, ...]] = dict(
    [
        *zip(GROUPS["api_keys"], [("sk-ant-",), ("sk-proj-",), ("sk-",), ("xai-",), ("AIza",)]),
        *zip(GROUPS["bearer_tokens"], [("author",), ("bearer",)]),
        *zip(GROUPS["jwt"], [("eyJ",)]),
        *zip(GROUPS["aws_keys"], [("AKIA", "ASIA"), ("acce",), ("amz-", "aw"), ("nature",)]),
        *zip(GROUPS["github_tokens"], [(f"gh{c}_",) for c in "pousr"]),
        *zip(GROUPS["pii"], [("@",), (), ("-",)]),
    ]
)
ORDER = ("api_keys", "bearer_tokens", "jwt", "aws_keys", "github_tokens", "custom_regex", "pii")


@dataclass
class RedactionConfig:
    """Which groups run. PII needs its name in ``patterns`` and ``redact_pii``."""

    enabled: bool = True
    patterns: tuple[str, ...] = ("api_keys", "bearer_tokens", "jwt", "aws_keys", "github_tokens")
    custom_regex: tuple[str, ...] = ()
    redact_pii: bool = False
    errors: list[str] = field(default_factory=list)


def _valid(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def active_groups(spark: SparkSession, config: RedactionConfig) -> list[tuple[str, list[str]]]:
    """Groups in evaluation order. Errors name a custom pattern by number and
    length, never by its text."""
    config.errors.clear()
    config.errors += [f"unknown group: {p}" for p in config.patterns if p not in GROUPS and p != "custom_regex"]
    out = []
    for name in ORDER if config.enabled else ():
        if name == "custom_regex":
            good = []
            for k, p in enumerate(config.custom_regex):
                if _valid(spark, p):
                    good.append(p)
                else:
                    config.errors.append(f"custom_regex[{k}] ({len(p)} characters) does not compile")
            if good:
                out.append((name, good))
        elif name in config.patterns and (name != "pii" or config.redact_pii):
            out.append((name, GROUPS[name]))
    return out


def _may_match(pattern: str) -> Column:
    text = F.lower("content") if pattern.startswith("(?iU)") else F.col("content")
    parts = PARTS.get(pattern, ())
    return reduce(or_, [text.contains(x) for x in parts]) if parts else F.lit(True)


def scrub(df: DataFrame, text: str, config: RedactionConfig) -> DataFrame:
    """Add content, match_count and groups_fired. Each pattern sees the text the
    patterns before it have left."""
    out = df.withColumn("content", F.col(text)).withColumn("match_count", F.lit(0))
    fired = []
    for name, patterns in active_groups(df.sparkSession, config):
        out = out.withColumn(f"_n_{name}", F.lit(0))
        for p in patterns:
            mark = F.lit(f"[REDACTED:{name}]")
            keep = [c for c in out.columns if c not in ("content", f"_n_{name}", "_hits")]
            # counted once, and replaced where something was found only
            out = out.withColumn("_hits", F.when(_may_match(p), F.regexp_count("content", F.lit(p))).otherwise(0))
            n = (F.col(f"_n_{name}") + F.col("_hits")).alias(f"_n_{name}")
            out = out.select(*keep, n, F.when(F.col("_hits") > 0, F.regexp_replace("content", F.lit(p), mark)).otherwise(F.col("content")).alias("content"))
        fired.append(name)
    counts = [F.coalesce(F.col(f"_n_{g}"), F.lit(0)) for g in fired]
    total = sum(counts, F.lit(0)) if counts else F.lit(0)
    names = F.filter(F.array(*[F.when(c > 0, F.lit(g)) for g, c in zip(fired, counts)]), lambda g: g.isNotNull()) if fired else F.array().cast("array<string>")
    out = out.withColumn("match_count", total).withColumn("groups_fired", names)
    return out.drop(*[f"_n_{g}" for g in fired])
