"""The near-dedup stage of the pipeline against brute force on planted copies of one to three edited words."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tests.llm.fixtures import documents, passage


def shingles_by_force(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_of_edited_words_go(spark):
    rng, docs = random.Random(5), []
    for i in range(60):
        docs.append((i, text := passage(3000 + i, rng.choice((90, 150, 250, 400))), "s0"))
        for edits in (1, 2, 3):
            words = text.split()
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"neu{i}x{edits}"
            docs.append((1000 * edits + i, " ".join(words), "s1"))
    docs += [(9000, None, "s0"), (9001, " \n", "s0"), (9002, "eins zwei", "s0"), (9003, "EINS  zwei", "s0"), (9004, "eins zwei drei", "s0"), (None, docs[0][1], "s2")]
    sets = {d: shingles_by_force(t) for d, t, _ in docs}
    nodes = sorted(sets, key=lambda d: -1 if d is None else d)
    group = {d: d for d in nodes}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        low, high = sorted((root(a), root(b)), key=nodes.index)
        group[high] = low
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, docs), "").collect()}
    assert len(pairs) > 200 and got == {root(d) for d in nodes}
    # measured recall: of the linked documents that brute force drops, all are dropped
    assert not {d for d in nodes if root(d) != d} & got


def test_template_below_the_similarity_makes_few_pairs(spark, monkeypatch):
    """Documents of one template at similarity 0.6 and 0.72: pairs in proportion to documents, none links; a long text is cut."""
    from ridewave.llm import near_copies as nc
    made, real = {}, nc.written
    monkeypatch.setattr(nc, "written", lambda df, name, *a: made.setdefault(name, real(df, name, *a)))
    monkeypatch.setattr(nc, "PIECE", 64)
    for own in (90, 55):
        made.clear()
        shared = passage(1, 300)
        docs = [(i, f"{shared} {passage(5000 + i, own)}", "s") for i in range(300)]
        long = passage(77, 3000)
        docs += [(1000, long, "s"), (1001, long + " ende", "s"), (1002, long + " " + passage(78, 200), "s"), (1003, long + " " + passage(79, 1500), "s")]
        got = {r["doc_id"] for r in nc.keep_one_near(documents(spark, docs)).collect()}
        assert got == set(range(300)) | {1000, 1003}
        assert made["near-pairs"].count() < 300 and max(made["near-pieces"].selectExpr("size(hashes)").toPandas().iloc[:, 0]) <= 120


def test_simhash_proposes_pairs_without_the_bands(spark, monkeypatch):
    """With a bucket of its own for each text, the pairs that op4 links are compared, and those only."""
    from ridewave.llm import near_copies as nc
    from tests.llm.test_operators import simhash_by_force
    monkeypatch.setattr(nc, "band_keys", lambda hashes, first: np.add.reduceat(hashes, first[:-1])[:, None] * np.arange(1, 25, dtype=np.uint64))
    docs = [(i, passage(7000 + i, 500), "s") for i in range(24)]
    docs += [(100 + i, f"{t} ende{i}", "s") for i, t, _ in docs[:12]] + [(200 + i, f"{t} {passage(7100 + i, 30)}", "s") for i, t, _ in docs[:12]]
    # the words of a cycle repeat: one fingerprint, but less than the similarity
    docs += [(300, "a b c d e f g " * 60, "s"), (301, "a b c d e f g " * 60 + passage(7300, 8), "s")]
    prints = {i: simhash_by_force(t) for i, t, _ in docs}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    sets = {i: shingles_by_force(t) for i, t, _ in docs}
    go = {b for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, docs), "").collect()}
    assert len(go) >= 6 and (300, 301) in near and got == set(prints) - go
