"""Periodic runs against every start, every end and every period."""

from __future__ import annotations

import hashlib
import random
import zlib

from ridewave.llm import periodic_runs as pr
from ridewave.llm.common import Words
from tests.llm.fixtures import documents, passage, rows_of
from tests.llm.test_operators import words_of


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(words[i] == words[i + p] for i in range(len(words) - p)))


def runs_by_force(words):
    """Every stretch that no neighbour extends, for every period; only those whose smallest period it is."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > i and end + q - i >= max(6, 4 * q) and smallest_period(words[i:end + q]) == q:
                found.append((i, end + q - i, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        few = [f"w{i}" for i in range(rng.choice((1, 2, 3, 6)))]
        block = [rng.choice(few) for _ in range(rng.randint(1, 14))]
        words = [rng.choice(few) for _ in range(rng.randint(0, 30))] + block * rng.randint(1, 9) + block[:rng.randint(0, len(block))]
        words += [rng.choice(few) for _ in range(rng.randint(0, 20))] + block * rng.randint(0, 6)
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(0, len(words)), rng.choice(few))
        texts.append(words)
    # two orders of the same 5-grams inside one long period: every short window recurs before the period does
    one, two = "a a a a a a b b b b b b".split(), "a a a a a a b a b b b b b b a b".split()
    texts += [(one + two) * 5, (one + two + two + one) * 4 + one, (two * 3 + one) * 6]
    assert pr.find_runs(Words([" ".join(w).encode() for w in texts])) == [runs_by_force(w) for w in texts]
    for w in texts[-60:]:
        assert pr.find_runs(Words([" ".join(w).encode()])) == [runs_by_force(w)]


def test_pairs_and_extensions_stay_few(monkeypatch):
    """One word, and long periods: extended once a stretch, and no more pairs than words in a class."""
    calls = []
    real = pr.reach
    monkeypatch.setattr(pr, "reach", lambda *a: calls.append(a) or real(*a))
    rng = random.Random(1)
    block = [str(rng.randrange(500)) for _ in range(3000)]
    words = ["x"] * 20_000 + block * 7 + ["y", "z"] * 9000
    found = pr.find_runs(Words([" ".join(words).encode()]))[0]
    assert (0, 20_000, 1) in found and (20_000, 21_000, 3000) in found and (41_000, 18_000, 2) in found
    assert len(calls) < 40
    texts = Words([" ".join(words).encode()])
    for _, positions, _ in pr.seeds(texts, texts.hashes()):
        assert len(positions) <= len(words)


def digest_by_force(doc, text):
    words = words_of(text)
    if doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
        n, g = len(words), zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digest(spark):
    base = [tuple(r) for r in documents(spark).select("doc_id", "text", "source").collect()]
    rows = base + [(1000 + i, passage(i, 5 + 3 * i), "s") for i in range(60)] + [(2000 + i, "ja nein " * (i + 1) + passage(i, 9), "s") for i in range(20)]
    rows += [(-5, "x " * 500 + "\ty\n" + "x " * 300, "s"), (-6, "a\x00b " * 40, None), (2003, "ja nein " * 4, "s")]
    df = documents(spark, rows).selectExpr("*", "1 AS runs", "2 AS n", "3 AS words", "4 AS collapsed")
    got = rows_of(pr.run_digest(df), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted((digest_by_force(d, t) for d, t, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 25
    plain = {r["doc_id"]: r for r in pr.periodic_runs(df.where("doc_id IN (2007, -5)")).collect()}
    assert plain[-5]["collapsed"] == "x y x" and [tuple(r) for r in plain[2007]["runs"]][0] == (0, 16, 2)
    assert pr.run_digest(df.limit(0)).count() == 0
