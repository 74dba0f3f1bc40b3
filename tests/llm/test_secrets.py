import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkrecall.llm.secrets import joined, scan

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def spans_of(df):
    return {r["doc_id"]: (r["b"], r["p"]) for r in scan(df).select("doc_id", joined(F.col("base")).alias("b"), joined(F.col("parts")).alias("p")).collect()}


def test_base_spans_against_regex(docs_of):
    rnd = random.Random(9)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD0123", "deadbeef", "0123456789abcdef", "secret", "é", "🎉", "x", "==", "\n", "A" * 12]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(1, 60))) for _ in range(400)]
    texts += [None, "", "token=secret: abcdefghijk", "é🎉 password = 'abcdefgh'", "x" * 500_000 + "AKIA" + "B" * 12, "password=" + "a" * 200_000, "é token=abcdefgh " * 3000]
    got = spans_of(docs_of(texts).selectExpr("*", "1 as base", "2 as row"))
    assert {i: b for i, (b, _) in got.items()} == {i: brute(t) for i, t in enumerate(texts)}
    for b, p in got.values():
        assert set(b.split(",")) <= set(p.split(",")) or not b


def test_links_need_complementary_parts(docs_of):
    key, secret = "AKIA" + "Q" * 16, "aB3" + "x" * 37
    far = " word" * 200
    texts = [
        f"{key} then {secret}",
        f"{key}{far} {secret}",
        f"only {secret} here",
        f"login: alice password=abcdefgh12 at https://db.example.com/x",
        f"login: alice and https://db.example.com/x",
        f"login: alice {secret}",
        f"login: alice {secret} https://db.example.com/x",
    ]
    got = spans_of(docs_of(texts))
    kinds = {i: {x.split(":")[0] for x in p.split(",") if x} for i, (_, p) in got.items()}
    assert kinds[0] == {"access", "weak_secret"} and kinds[1] == {"access"} and kinds[2] == set()
    assert kinds[3] == {"assign", "weak_id", "endpoint"}
    assert kinds[4] == set() and kinds[5] == set() and kinds[6] == {"weak_id", "weak_secret"}


def test_repeated_rows_and_empty(docs_of):
    t = "AKIA" + "Q" * 16 + " aB3" + "x" * 37
    got = scan(docs_of([t, t, t], ids=[1, 1, None])).collect()
    assert len(got) == 3 and all(len(r["parts"]) == 2 for r in got)
    assert scan(docs_of([])).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(brute(None).encode()).hexdigest()
