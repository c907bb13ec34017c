"""Periodic runs: the grammar against brute force, and the query on the smallest tables."""

import hashlib
import random
import re
import zlib

import pytest

from runlens.llm import periodic_runs
from runlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, length, period) by comparing every word with the one ``period`` further on."""
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                own = words[start : i + p]
                if not any(own[q:] == own[:-q] for q in range(1, p)):
                    out.append((start, len(own), p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query(spark, sf_dir):
    rows = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute_row(planted(r.doc_id, WORD.findall(texts[r.doc_id] or "")))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected
    assert sum(r.n_runs > 0 for r in rows) > len(rows) / 20


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 5)):
            words = [bytes([97 + rng.randrange(rng.choice([1, 2, 4]))]) for _ in range(rng.randint(0, 90))]
            for _ in range(rng.randint(0, 3) if words else 0):
                a = rng.randrange(len(words))
                p = rng.randint(1, len(words) - a)
                for i in range(a, rng.randint(a, len(words))):
                    words[i] = words[a + (i - a) % p]
            lists.append(words)
        assert [[tuple(r) for r in runs.tolist()] for runs in periodic_runs.text_runs(lists)] == [brute_runs(x) for x in lists]


@pytest.mark.parametrize("words", [
    [b"a"] * 5000, [b"a", b"b"] * 2500, [b"a"] * 5 + [b"b"] * 5, ([b"a"] * 6 + [b"b"]) * 6, [b"x", *[b"a"] * 6], [str(i).encode() for i in range(500)],
])
def test_known_texts(words):
    assert [tuple(r) for r in periodic_runs.text_runs([words])[0].tolist()] == brute_runs(words)


def test_fibonacci_words():
    a, b = b"a", b"ab"
    while len(b) < 1500:
        a, b = b, b + a
    words = [bytes([c]) for c in b]
    assert [tuple(r) for r in periodic_runs.text_runs([words])[0].tolist()] == brute_runs(words)


def test_extensions():
    """Both directions against a word by word comparison, across blocks of every length."""
    rng = random.Random(9)
    for _ in range(60):
        body = [rng.randrange(2) for _ in range(rng.randint(2, 80))]
        symbols = [5, *body, 6]
        grammar = periodic_runs.Grammar(periodic_runs.np.array(symbols), 4)
        pairs = [(i, j) for i in range(1, len(body) + 1) for j in range(1, len(body) + 1) if i != j]
        i, j = (periodic_runs.np.array(x) for x in zip(*pairs, strict=True))
        for (x, y), after, ahead in zip(pairs, grammar.after(i, j), grammar.ahead(i, j), strict=True):
            n = next(k for k in range(len(symbols)) if symbols[x + k] != symbols[y + k])
            m = next(k for k in range(len(symbols)) if symbols[x - 1 - k] != symbols[y - 1 - k])
            assert (after, ahead) == (n, m)


def test_odd_rows(spark):
    run = "a b " * 10
    rows = [(1, run, "x", 1), (1, run, "x", 1), (None, run, None, None), (2, None, "x", 1), (3, "", None, 2), (4, " \n\t ", "y", 3), (5, "one two", "z", 4), (6, "é " * 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    out = periodic_runs.find_runs(docs, with_text=True, with_runs=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out) == [-1, 1, 1, 2, 3, 4, 5, 6]
    nothing = hashlib.sha256(b"").hexdigest()
    for r in out:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (0, 0, None, None, None, None)
            assert r.runs_sha256 == r.collapsed_sha256 == nothing and r.collapsed_text == "" and r.runs == []
        elif r.doc_id in (1, None):
            assert (r.start, r.length, r.period, r.exponent_milli, r.collapsed_text) == (0, 20, 2, 10000, "a b")
        elif r.doc_id == 6:
            assert (r.n_runs, r.period, r.collapsed_text) == (1, 1, "é")
    none = periodic_runs.find_runs(docs.where("false"))
    assert none.collect() == []
    text = docs.select("doc_id", periodic_runs.planted_text(docs["doc_id"], docs["text"]).alias("text"))
    assert text.count() == len(rows)


def test_long_text(spark):
    words = [f"w{i % 91}" for i in range(40_000)]
    docs = spark.createDataFrame([("k", " ".join(words))], "doc_id string, text string")
    row = periodic_runs.find_runs(docs).first()
    assert (row.doc_id, row.n_runs, row.start, row.length, row.period) == ("k", 1, 0, 40_000, 91)
