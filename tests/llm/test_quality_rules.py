"""The rule ledger, its policies and ablations against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from ridewave.llm import quality_rules as qr
from tests.llm.fixtures import documents, passage, rows_of
from tests.llm.test_operators import words_of


def measures_by_force(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(x) for x in "#*$%&|<>"),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_letter_words": sum(any(x.isalpha() for x in w) for w in words), "n_capitals": sum("A" <= x <= "Z" for x in text),
            "n_distinct_words": len(set(words))}


def failures_by_force(m):
    n, chars = m["n_words"], m["word_chars"]
    fails = [n < 10, 100 * m["n_repeat_words"] > 20 * n, 10 * m["n_symbols"] > n, 10 * m["n_dup_lines"] > 3 * m["n_lines"],
             10 * m["n_letter_words"] < 7 * n, 10 * m["n_capitals"] > 3 * chars, chars < 3 * n or chars > 12 * n, 10 * m["n_distinct_words"] < n]
    return sum(1 << i for i, x in enumerate(fails) if x)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    few = ["a", "bb", "ccc", "#", "12", "EIN", "\U0001f600x", "é"]
    rows = [(i, "".join(rng.choice(few) + rng.choice((" ", " ", "\n", "\t", "\n\n", "\r\n")) for _ in range(rng.choice((0, 3, 7, 40, 300)))), "s") for i in range(150)]
    rows += [(200 + i, " ".join(rng.choice(few[:2]) for _ in range(60)), "s") for i in range(20)]
    rows += [(300, "x" * 200_000, "s"), (301, "9" * 100_000 + "\n" + "7 " * 30_000, "s"), (302, " ".join(passage(i, 40) for i in range(700)), "s"),
             (303, "GANZ LAUT " * 20, "s"), (304, f"{passage(3, 12)}\n" * 4 + passage(4, 90), "s"), (None, passage(5, 50), None), (303, None, "s"), (7, "", "s")]
    basic = [tuple(r) for r in documents(spark).select("doc_id", "text", "source").collect()]
    return documents(spark, rows + basic).withColumnsRenamed({"route": "failures", "kind": "n"}).selectExpr("*", "'u' AS words", "1 AS kept", "2 AS bits")


def test_measures_and_bits(spark, table):
    order = ["doc_id", *qr.MEASURES, "failures"]
    want = sorted(((r["doc_id"], *[(m := measures_by_force(r["text"]))[k] for k in qr.MEASURES], failures_by_force(m)) for r in table.collect()), key=repr)
    assert rows_of(qr.ledger(table), *order) == want


def test_policies(spark, table):
    got = {}
    for r in qr.quality_rules(table).collect():
        got.setdefault(r["doc_id"], []).append((r["base_failed"], r["kept"]))
    base, hard = qr.mask(qr.BASE.hard), qr.mask(qr.POLICIES[-1].hard)
    soft, limit = qr.mask(qr.POLICIES[-1].soft), qr.POLICIES[-1].limit
    want = {}
    for r in table.collect():
        bits = failures_by_force(measures_by_force(r["text"]))
        want.setdefault(r["doc_id"], []).append((bits & base != 0, bits & (base | hard) == 0 and (bits & soft).bit_count() < limit))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert qr.quality_rules(table.limit(0)).count() == 0


def test_ablations(spark, table):
    policies = (*qr.POLICIES, qr.Policy("two", ("symbols",), ("few_words", "word_length", "few_distinct"), 2))
    got = {(r["policy"], r["rule"]): r for r in qr.ablations(qr.ledger(table), policies).collect()}
    facts = [(failures_by_force(m := measures_by_force(r["text"])), m["n_words"]) for r in table.collect()]
    assert len(got) == sum(len(p.hard + p.soft) for p in policies)
    for p in policies:
        def out(bits, rules, p=p):
            return bool(bits & qr.mask([x for x in p.hard if x in rules])) or (bits & qr.mask([x for x in p.soft if x in rules])).bit_count() >= p.limit
        every = set(p.hard + p.soft)
        for rule in every:
            row, bit = got[p.version, rule], qr.mask([rule])
            saved = [(b, n) for b, n in facts if out(b, every) and not out(b, every - {rule})]
            assert row["failed"] == sum(bool(b & bit) for b, _ in facts) and row["rejected"] == sum(out(b, every) for b, _ in facts)
            assert (row["saved"], row["saved_words"]) == (len(saved), sum(n for _, n in saved))
            both = [b for b, _ in facts if b & bit and out(b, every)]
            together, always = None, None
            for b in both:
                together, always = b if together is None else together | b, b if always is None else always & b
            assert (row["together"], row["always"]) == (together, always)


def test_matches_sql(spark):
    from tests.oracle import check, engine
    sf = "/root/testdata/sf0.001"
    message, _, ok = check(spark, engine(sf), "op11", lambda s, d: qr.quality_rules(s.read.parquet(f"{d}/documents.parquet")), qr.SQL, sf)
    assert ok, message
