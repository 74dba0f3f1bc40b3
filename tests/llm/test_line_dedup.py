import hashlib
import random

from sparkrecall.llm.line_dedup import dedup_lines


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    long = [sum(w != "" for w in x.split(" ")) >= 50 for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        last = i + 1 == len(lines)
        if last or long[i] or long[i + 1] or (h[i] + 31 * (h[i - 1] if i else 0)) % 4 == 0:
            out.append((start, i + 1))
            start = i + 1
    return lines, [(a, b) for a, b in out if b - a > 1 or long[a]]


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = (0, 0, None)
            continue
        lines, spans = cut(t)
        gone = set()
        for a, b in spans:
            c = "\n".join(lines[a:b])
            if c in seen:
                gone.update(range(a, b))
            seen.add(c)
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_against_brute_force(docs_of, words):
    rnd = random.Random(11)
    block = [" ".join(rnd.choices(words, k=6)) for _ in range(30)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = []
    for _ in range(60):
        own = [" ".join(rnd.choices(words, k=rnd.randint(0, 8))) for _ in range(rnd.randint(1, 12))]
        if rnd.random() < 0.5:
            own[2:2] = block[5:25]
        if rnd.random() < 0.5:
            own.insert(rnd.randint(0, len(own)), passage)
        texts.append("\n".join(own))
    texts += [None, "", "\n", "\n\n\n", passage, "\n".join(block * 40), "x" * 300_000]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(docs_of(texts).selectExpr("*", "1 as chunk")).collect()}
    assert got == brute(list(enumerate(texts)))
    kept = sum(passage in (g[2] or "") for g in got.values())
    assert kept == 1


def test_repeated_rows_and_empty_table(docs_of, words):
    body = "\n".join(" ".join(words[i : i + 60]) for i in range(3))
    got = dedup_lines(docs_of([body, body, body], ids=[4, 4, None])).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=str) == sorted([(4, 0), (4, 0), (None, 3)], key=str)
    assert dedup_lines(docs_of([])).count() == 0
