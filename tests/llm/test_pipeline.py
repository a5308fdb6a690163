"""The pipeline's stages against brute force on tables planted with junk, copies and benchmark passages."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from ridewave.llm import quality as ql
from ridewave.llm import token_files as tf
from ridewave.llm.decontaminate import WINDOW
from ridewave.llm.mixing import mixing_plan
from ridewave.llm.queries import QUERIES, vocabulary_path
from tests.llm.fixtures import documents, passage, rows_of
from tests.llm.test_operators import hits_by_force, plain_words, simhash_by_force, words_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, passage(900 + i, 30)) for i in range(3)]
    docs, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        text = passage(i, 80) if good else " ".join(w.upper() + "!!" for w in passage(i, 80).split())
        docs.append((i, text, f"s{i % 5}"))
        labels.append((i, int(good), 0))
    docs += [(300 + i, docs[5][1], "s1") for i in range(10)]  # copies
    docs += [(400 + i, f"{passage(700 + i, 60)} {items[i][1]} {passage(800 + i, 60)}", "s2") for i in range(3)]
    docs += [(403, items[0][1], "s2"), (404, docs[6][1], None), (405, None, "s2"), (404, docs[6][1], None)]
    documents(spark, docs).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_by_force(spark, tables):
    read = lambda path: spark.read.parquet(path)
    docs = read(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tables}/out-{name}")
        seen[name] = (docs, out := read(f"{tables}/out-{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    # quality: exactly the documents that reach the threshold
    before, after = seen["quality"]
    scored = ql.quality_scores(before, read(f"{tables}/labels.parquet")).where("predicted = 1")
    assert Counter(rows_of(after, "doc_id")) == Counter(rows_of(scored, "doc_id"))
    clean = {(i,) for i in range(200) if i % 4 > 0}
    assert len(clean & set(rows_of(after, "doc_id"))) >= 0.97 * len(clean) and not {(i,) for i in range(0, 200, 4)} & set(rows_of(after, "doc_id"))
    # near-dedup: the smallest id of each group of near fingerprints
    before, after = seen["near_dedup"]
    prints = sorted({(r["doc_id"], simhash_by_force(r["text"])) for r in before.collect()})
    nodes = sorted({p for _, p in prints})
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                group[root(b)] = root(a)
    least: dict = {}
    for d, p in prints:
        least.setdefault(root(p), d)
    assert rows_of(after, "doc_id") == sorted(((d,) for d in least.values()), key=repr)
    # decontamination: no window of the benchmark is left, everything else is
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read(f"{tables}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        words, hit, _ = hits_by_force(r["text"], items)
        if len(hit) > 0.8 * len(words):
            assert r["doc_id"] not in got
        else:
            assert plain_words(got[r["doc_id"]]) == [w for i, w in enumerate(words) if i not in hit]
    assert len(plain_words(items[0][1])) > WINDOW and 403 not in got and 400 in got
    # mixing: the words that the plan takes
    before, after = seen["mixing"]
    want = Counter({r["doc_id"]: r["taken"] for r in mixing_plan(before).collect() if r["taken"]})
    mixed: Counter = Counter()
    for r in after.collect():
        mixed[r["doc_id"]] += len(words_of(r["text"]))
    assert mixed == want
    # token files: positions, counts and checks of every row
    before, after = seen["token_output"]
    tokenizer = tf.encoder(vocabulary_path()).tokenizer
    ids = Counter()
    for r in before.collect():
        coded = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        ids[r["doc_id"], len(coded), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in coded))] += 1
    rows = after.orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == ids
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert rows_of(corpus_pipeline.run(spark, tables), "start", "n_tokens", "ids_crc32") == rows_of(after, "start", "n_tokens", "ids_crc32")


def test_stages_on_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_registered_names_and_twins():
    import __spark_entry__ as entry
    from ridewave.llm.queries import SQL
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_source_mixing", "op9_decontamination"])
def test_queries_match_their_sql(spark, name):
    from ridewave.llm.queries import SQL
    from tests.oracle import check, engine
    sf = "/root/testdata/sf0.001"
    message, _, ok = check(spark, engine(sf), name, QUERIES[name], SQL[name], sf)
    assert ok, message
