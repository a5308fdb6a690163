"""Hard negatives against all inner products, with ties, copies, nulls and odd lengths; and what the tree leaves out."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ridewave.llm import hard_negatives as hn
from tests.llm.fixtures import rows_of

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, tile string, v int"


def by_force(rows, every=50, positives=5, negatives=3):
    live = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        live[i] = min(live.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in live.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in live.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


def table(seed=3, n=700, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(9)] + rng.normal(size=width) * 0.3
        rows.append((i, [float(x) for x in v], int(rng.choice([0, 0, 0, 1, 2, 3]))))
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(150)]  # copies of one vector: ties everywhere
    rows += [(50 * i + 5000, [], i % 2) for i in range(3)] + [(5201, [1.0, 2.0], 1), (5250, [1.0, 2.0, 0.5, 0.5, 0.0, 0.0, 3.0], 0), (5300, [-1.0] * width, 2)]
    rows += [(6000, None, 1), (6050, [1.0] * width, None), (None, [1.0] * width, 1), (6100, [float("nan")] + [1.0] * 5, 1), (6150, [float("inf")] * 6, 0), (6200, [None, 1.0], 1)]
    rows += [(100, [0.25] * width, 0), (100, [0.25] * width, 0), (150, [0.1] * width, 3), (-50, [0.7] * width, 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.mark.parametrize("settings", [{}, {"group": 600, "tile": 40, "leaf": 7}, {"group": 6 * 200, "tile": 16, "leaf": 16}])
def test_by_force(spark, rows, settings):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    got = rows_of(hn.hard_negatives(hn.prepared(df), **settings), *COLUMNS)
    assert got == by_force(rows) and len({r[0] for r in got}) > 10


def test_moved_labels_and_empty(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    moved = [(i, e, label if label is None or i is None or i % 7 else (label + 1) % 10) for i, e, label in rows]
    assert rows_of(hn.mined(df), *COLUMNS) == by_force(moved)
    assert hn.mined(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hn.hard_negatives(hn.prepared(spark.createDataFrame([(50, [1e12], 0, "t", 1)], SCHEMA)))


def test_leaves_and_boxes(spark, rows):
    df = hn.prepared(spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA))
    tree, n, width = hn.build(df, tile=64, leaf=10)
    leaves = tree.collect()
    assert sum(len(r["ids"]) for r in leaves) == n == df.count() and max(len(r["ids"]) for r in leaves) <= 10
    want = {r["vec_id"]: (r["label"], list(r["v"]) + [0] * (width - len(r["v"]))) for r in df.collect()}
    tiles = {}
    for r in leaves:
        m = np.array(r["vectors"]).reshape(-1, width)
        assert list(m.min(0)) == r["low"] and list(m.max(0)) == r["high"]
        assert [want.pop(i) for i in r["ids"]] == [(r["label"], list(v)) for v in m]
        tiles[r["tile"]] = tiles.get(r["tile"], 0) + len(r["ids"])
    assert not want and max(tiles.values()) <= 64


def test_boxes_spare_products():
    """On clustered vectors most leaves are never scored; the result is that of all products."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (40, 4))
    vectors = centres[rng.integers(0, 40, 6000)] + rng.integers(-6, 6, (6000, 4))
    leaves = [(t, 0, r + 3000 * t, vectors[3000 * t + r], None, None) for t in range(2) for r in hn.pack(vectors[3000 * t:3000 * t + 3000], np.arange(3000), np.arange(4), 50)]
    leaves = [(t, label, ids, v.reshape(-1), v.min(0), v.max(0)) for t, label, ids, v, _, _ in leaves]
    tree, scored = hn.Tree(leaves, 4), []

    class Counted(list):
        def __getitem__(self, i):
            scored.append(i)
            return super().__getitem__(i)

    tree.vectors = Counted(tree.vectors)
    anchors = vectors[:3]
    none, top = np.full((3, 1), hn.NONE), np.full((3, 1), -hn.NONE)
    slot, score, ids = hn.search(tree, np.arange(3), anchors, np.zeros(3, int), none, top, none, True, 5)
    want = [(a, s, i) for a in range(3) for s, i in sorted((-(int(x)), i) for i, x in enumerate(vectors @ anchors[a]) if i != a)[:5]]
    assert [(a, -s, i) for a, s, i in zip(slot.tolist(), score.tolist(), ids.tolist(), strict=True)] == want
    assert len(scored) < len(leaves) / 3


def test_matches_sql(spark):
    from tests.oracle import check, engine
    sf = "/root/testdata/sf0.001"
    message, _, ok = check(spark, engine(sf), "op13", lambda s, d: hn.mined(s.read.parquet(f"{d}/embeddings.parquet")), hn.SQL, sf)
    assert ok, message
