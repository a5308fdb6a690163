"""Hard negatives by an STR-packed R-tree over vectors, searched best first.

**Packing.**  Rows are sort-tile-recursive: a range exchange by (label, widest coordinate, vec_id) cuts slabs, each slab is
sorted by (label, second widest coordinate, vec_id) and cut into tiles of one label and at most ``TILE`` rows, and a tile is
cut on through its own widest coordinates into leaves of at most ``LEAF`` rows.  Row numbers cut, so ties and copies of one
vector spread like any rows.  A leaf carries its minimum bounding box; the tree is stored, one row a leaf.

**Search.**  For an anchor, a box bounds the inner product coordinate by coordinate: a positive coordinate of the anchor takes
the box's high end for the upper and its low end for the lower bound, a negative one the reverse.  Tiles and leaves wait
in a queue ordered by that upper bound, cut to the window's upper end.  A box is left out when its scores lie outside of all open
windows, or strictly below the kth score found: a tie could still win by its vec_id.  Anchors go through
the tree in blocks of ``BLOCK`` neighbours, so a leaf's scores are one product of matrices.

**Spread.**  Tiles are dealt into groups of bounded size by a hash, whatever their label.  Every anchor first searches the group of
its own tile; the kth score found there bounds its search in every other group, where it goes with its vector and
windows only.  A group streams into a task before the anchors that ask it; a task holds one group and one block.
Nothing passes the driver but two coordinates, the number of rows and the largest component.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; of rows that share
a vec_id the one with the smallest label, then the smallest vector, takes part; shorter vectors are continued with zeros, an
empty one has score 0 with all; components whose scores may not fit in 56 bits raise an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.llm.common import shuffle_partitions, small_batches, written

TILE, LEAF, BLOCK = 4096, 128, 128
GROUP = 1 << 23  # numbers of the vectors that one task holds
NONE = -2**62
LEAVES = "tile bigint, label int, ids array<bigint>, vectors array<bigint>, low array<bigint>, high array<bigint>"
HITS = "anchor_id bigint, slot int, id bigint, score bigint"


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v: floor(scale * component) of every row that takes part."""
    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), e.alias("e")).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL")
    wild = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("e", wild)).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def widest(rows: DataFrame) -> tuple[int, int, int, list[int]]:
    """Number of rows, length of the longest vector, largest component, and the two coordinates of greatest variance (over all rows)."""
    cells = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("spread"), F.max(F.abs("x")).alias("most"))
    sizes = cells.agg(F.max("at"), F.max("most")).first()
    wide = [r["at"] for r in cells.orderBy(F.desc("spread"), "at").limit(2).collect()]
    return rows.count(), (sizes[0] if sizes[0] is not None else -1) + 1, sizes[1] or 0, (wide + [0, 0])[:2]


def pack(vectors: np.ndarray, rows: np.ndarray, axes: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Row numbers of each leaf: sorted by the first axis, cut into slabs of whole leaves, each cut on along the other axes."""
    if len(rows) <= leaf:
        yield rows
        return
    pages = -(-len(rows) // leaf)
    slabs = max(2, round(pages ** (1 / max(1, len(axes)))))
    size = -(-pages // slabs) * leaf
    ordered = rows[np.argsort(vectors[rows, axes[0]], kind="stable")] if len(axes) else rows
    for at in range(0, len(rows), size):
        yield from pack(vectors, ordered[at:at + size], axes[1:], leaf)


def arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The lists of a column as arrays (null: empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    values = np.asarray(column.flatten(), np.int64)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))
    return np.split(values, ends[:-1]) if len(ends) else []


def build(rows: DataFrame, tile: int = TILE, leaf: int = LEAF) -> tuple[DataFrame, int, int]:
    """The stored tree (a row a leaf), the number of rows and the length of the vectors."""
    rows = written(rows, "vectors")
    n, width, most, (one, two) = widest(rows)
    if width * most * most >= 2**56:
        raise ValueError("inner products do not fit: components are too large")
    slabs = max(1, round((n / tile) ** 0.5))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        numbered = TaskContext.get().partitionId() << 32

        def cut() -> pa.RecordBatch:
            nonlocal numbered
            vectors = np.zeros((len(held), width), np.int64)
            for i, (_, _, v) in enumerate(held):
                vectors[i, :len(v)] = v
            ids = np.array([h[0] for h in held], np.int64)
            axes = np.argsort(-vectors.var(0), kind="stable")[:8]
            out = [(numbered, held[0][1], ids[r], vectors[r].reshape(-1), vectors[r].min(0), vectors[r].max(0)) for r in pack(vectors, np.arange(len(held)), axes, leaf)]
            numbered += 1
            held.clear()
            kinds = (pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4)
            return pa.record_batch([pa.array(list(column), kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                                   names=["tile", "label", "ids", "vectors", "low", "high"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrays(batch, "v"), strict=True):
                if held and (len(held) == tile or held[0][1] != row[1]):
                    yield cut()
                held.append(row)
        if held:
            yield cut()

    place = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0))
    keyed = rows.select("vec_id", "label", "v", place(one).alias("one"), place(two).alias("two"))
    dealt = keyed.repartitionByRange(slabs, "label", "one", "vec_id").sortWithinPartitions("label", "two", "vec_id")
    small_batches(rows.sparkSession)
    return written(dealt.select("vec_id", "label", "v").mapInArrow(leaves, LEAVES), "rtree"), n, width


class Tree:
    """The leaves of one group of tiles, with the boxes of leaves and tiles."""

    def __init__(self, leaves: list[tuple], width: int):
        leaves.sort(key=lambda x: (x[0], x[2][0]))
        self.ids = [np.asarray(x[2], np.int64) for x in leaves]
        self.vectors = [np.asarray(x[3], np.int64).reshape(len(x[2]), width) for x in leaves]
        self.low = np.array([x[4] for x in leaves], np.int64).reshape(len(leaves), width)
        self.high = np.array([x[5] for x in leaves], np.int64).reshape(len(leaves), width)
        tiles = np.array([x[0] for x in leaves], np.int64)
        self.first = np.flatnonzero(np.diff(tiles, prepend=-1))
        self.label = np.array([leaves[i][1] for i in self.first], np.int64)
        self.end = np.append(self.first[1:], len(leaves))
        self.tile_low = np.minimum.reduceat(self.low, self.first) if len(leaves) else self.low
        self.tile_high = np.maximum.reduceat(self.high, self.first) if len(leaves) else self.high
        most = max(1, int(np.abs(self.low).max(initial=0)), int(np.abs(self.high).max(initial=0)))
        self.most = most * max(1, width)

    def numbers(self, largest: int) -> type:
        """Doubles, whose products are exact up to 2**53 and run through BLAS; otherwise integers."""
        return np.float64 if self.most * largest < 2**53 else np.int64


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector (row) with any point of each box (column)."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k[slot] of every slot by score (descending) and id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    start = np.flatnonzero(np.diff(slot, prepend=-1))
    rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
    keep = rank < k[slot]
    return slot[keep], score[keep], ids[keep]


def search(tree: Tree, anchors: np.ndarray, vectors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, same: bool, k: int):
    """The first k rows of every window [low, high] of every anchor, best first: (slot, score, id), slot = anchor * windows + window.

    low, high and floor have a row for each anchor and a column for each window (an empty window: low above high); rows below
    ``floor`` are not asked for.  ``same``: rows of the anchor's label but for itself; otherwise rows of other labels.
    """
    windows, none = low.shape[1], (np.empty(0, np.int64),) * 3
    if not len(tree.ids):
        return none
    kind = tree.numbers(int(np.abs(vectors).max(initial=0)))
    v = vectors.astype(kind)
    kth = np.maximum(low, floor).reshape(-1)  # scores below are not needed
    top, ks = high.reshape(-1), np.full(low.size, k)
    found = none

    def wanted(least: np.ndarray, greatest: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors still need each box, and the queue's key: the best score any window could get from it."""
        lo, hi = np.repeat(least, windows, 0), np.minimum(np.repeat(greatest, windows, 0), top[:, None])
        opened = (hi >= np.maximum(kth, low.reshape(-1))[:, None]) & (lo <= top[:, None])
        opened = opened.reshape(len(v), windows, -1).any(1) & allowed
        key = np.where(np.repeat(opened, windows, 0), hi, NONE).max(0, initial=NONE)
        return opened, key

    allowed = (labels[:, None] == tree.label[None, :]) == same
    tile_least, tile_greatest = (x.astype(np.int64) for x in bounds(v, tree.tile_low.astype(kind), tree.tile_high.astype(kind)))
    opened, key = wanted(tile_least, tile_greatest, allowed)
    queue = [(-int(key[t]), 0, t) for t in np.flatnonzero(opened.any(0))]
    heapq.heapify(queue)
    boxes: dict[int, tuple] = {}
    while queue:
        _, level, node = heapq.heappop(queue)
        if level == 0:  # a tile opens into its leaves
            part = slice(tree.first[node], tree.end[node])
            least, greatest = (x.astype(np.int64) for x in bounds(v, tree.low[part].astype(kind), tree.high[part].astype(kind)))
            may = np.repeat(allowed[:, node:node + 1], least.shape[1], 1)
            opened, key = wanted(least, greatest, may)
            for i in np.flatnonzero(opened.any(0)):
                boxes[int(part.start + i)] = (least[:, i:i + 1], greatest[:, i:i + 1], may[:, i:i + 1])
                heapq.heappush(queue, (-int(key[i]), 1, int(part.start + i)))
            continue
        opened, _ = wanted(*boxes.pop(node))
        asking = np.flatnonzero(opened[:, 0])
        if not len(asking):
            continue
        score = (v[asking] @ tree.vectors[node].astype(kind).T).astype(np.int64)
        if same:
            score[anchors[asking][:, None] == tree.ids[node][None, :]] = NONE
        slots = (asking[:, None] * windows + np.arange(windows)[None, :]).reshape(-1)
        each = np.repeat(score, windows, 0)
        which, row = np.nonzero((each >= kth[slots][:, None]) & (each <= top[slots][:, None]) & (each != NONE))
        if not len(which):
            continue
        found = best(*(np.concatenate(pair) for pair in zip(found, (slots[which], each[which, row], tree.ids[node][row]), strict=True)), ks)
        full = np.bincount(found[0], minlength=len(kth)) == k
        worst = np.full(len(kth), -NONE)
        np.minimum.at(worst, found[0], found[1])
        kth = np.where(full, np.maximum(kth, worst), kth)
    return found


def probe(asked: DataFrame, index: DataFrame, width: int, same: bool, k: int, units: Column) -> DataFrame:
    """anchor_id, slot, id, score: what every anchor finds in the group it asks.

    ``asked``: unit, anchor_id, label, v, lows, highs, floors; ``index``: the leaves with their group, whose ``units`` (an array) they serve.
    Leaves come before anchors in a unit, so a task holds one group's tree and one block of anchors.
    """
    spark = asked.sparkSession
    none, numbers = F.lit(None), "array<bigint>"
    served = index.select(F.explode(units).alias("unit"), F.lit(0).alias("kind"), "tile", "label", "ids", "vectors", "low", "high",
                          none.cast("bigint").alias("anchor_id"), *[none.cast(numbers).alias(x) for x in ("lows", "highs", "floors")])
    rows = asked.select("unit", F.lit(1).alias("kind"), F.col("tile"), "label", none.cast(numbers).alias("ids"), F.col("v").alias("vectors"),
                        none.cast(numbers).alias("low"), none.cast(numbers).alias("high"), "anchor_id", "lows", "highs", "floors")
    dealt = served.unionByName(rows).repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "kind", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, leaves, tree, block = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, tree, leaves
            if block:
                if tree is None:
                    tree, leaves = Tree(leaves, width), []
                windows = max(len(b[3]) for b in block)
                fill = lambda at, blank: np.array([list(b[at]) + [blank] * (windows - len(b[at])) for b in block], np.int64).reshape(len(block), windows)
                ids = np.array([b[0] for b in block], np.int64)
                vectors = np.array([b[2] for b in block], np.int64).reshape(len(block), width)
                slot, score, hit = search(tree, ids, vectors, np.array([b[1] for b in block]), fill(3, 0), fill(4, NONE), fill(5, NONE), same, k)
                yield pa.record_batch([pa.array(ids[slot // windows]), pa.array((slot % windows).astype(np.int32)), pa.array(hit), pa.array(score)],
                                      names=["anchor_id", "slot", "id", "score"])
            block = []

        for batch in batches:
            plain = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("unit", "kind", "tile", "label", "anchor_id")]
            lists = [arrays(batch, x) for x in ("ids", "vectors", "low", "high", "lows", "highs", "floors")]
            for at, kind, tile, label, anchor, ids, vectors, low, high, lows, highs, floors in zip(*plain, *lists, strict=True):
                if at != unit:
                    yield from flush()
                    unit, leaves, tree = at, [], None
                if kind == 0:
                    leaves.append((tile, label, ids.copy(), vectors.copy(), low, high))
                else:
                    block.append((anchor, label, vectors, lows, highs, floors))
                    if len(block) == BLOCK:
                        yield from flush()
        yield from flush()
    small_batches(spark)
    return dealt.mapInArrow(run, HITS)


def first_rows(hits: DataFrame, k: int) -> DataFrame:
    """found: the first k (score, id) of each anchor and slot, in order, merged from sorted pieces that never hold more than k."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("found"))


def ask(anchors: DataFrame, index: DataFrame, groups: int, width: int, same: bool, k: int, windows: DataFrame | None = None) -> DataFrame:
    """anchor_id, slot, found: the first k rows of each anchor (``same`` label), or of each of its windows (other labels).

    ``windows``: anchor_id, lows, highs.  The anchor's own group is asked first; its kth scores bound what the other groups return.
    """
    anyone = F.array(F.lit(NONE).cast("bigint"))
    asked = anchors.withColumns({"lows": anyone, "highs": F.array(F.lit(-NONE).cast("bigint"))}) if windows is None else anchors.join(windows, "anchor_id")
    # few groups are served to several tasks, each with a part of the anchors
    parts = max(1, -(-shuffle_partitions(anchors.sparkSession) // (2 * groups)))
    unit = lambda group: group * parts + F.pmod(F.xxhash64("tile"), F.lit(parts))
    units = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.col("group") * parts + i)
    home = asked.withColumn("floors", F.transform("lows", lambda _: F.lit(NONE).cast("bigint"))).withColumn("unit", unit(F.col("group")))
    near = written(probe(home, index, width, same, k, units), "negatives-near")
    if groups == 1:
        return first_rows(near, k)
    kept = first_rows(near, k)
    floor = kept.where(F.size("found") == k).select("anchor_id", F.struct("slot", F.element_at("found", -1)["score"].alias("score")).alias("f"))
    floor = floor.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list("f")).alias("kth"))
    far = asked.join(floor, "anchor_id", "left").withColumn("floors", F.transform(
        "lows", lambda _, i: F.coalesce(F.try_element_at("kth", i), F.lit(NONE).cast("bigint"))))
    others = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != F.col("group"))
    far = far.withColumn("asked", F.explode(others)).withColumn("unit", unit(F.col("asked")))
    return first_rows(near.unionByName(probe(far, index, width, same, k, units)), k)


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   group: int = GROUP, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings``: vec_id, label, v as ``prepared`` gives them.  Anchors: ids divisible by ``every``; their first ``positives`` rows of the
    same label by inner product, and for each the first ``negatives`` rows of other labels with ``least`` to ``most`` hundredths of its score.
    """
    tree, n, width = build(embeddings, tile, leaf)
    groups = max(1, -(-n * width // group))
    index = tree.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    rows = index.select("tile", "group", "label", "vectors", F.posexplode("ids").alias("at", "anchor_id")).where(F.col("anchor_id") % every == 0)
    anchors = written(rows.select("anchor_id", "label", "tile", "group", F.slice("vectors", F.col("at") * width + 1, F.lit(width)).alias("v")), "anchors")
    found = ask(anchors, index, groups, width, True, positives)
    pairs = written(found.select("anchor_id", F.posexplode("found").alias("slot", "f")).select(
        "anchor_id", "slot", F.col("f.id").alias("positive_id"), F.col("f.score").alias("positive_score")), "positives")
    low = F.expr(f"{least} * positive_score div 100 + CASE WHEN {least} * positive_score % 100 > 0 THEN 1 ELSE 0 END")  # rounded up
    high = F.expr(f"{most} * positive_score div 100 - CASE WHEN {most} * positive_score % 100 < 0 THEN 1 ELSE 0 END")  # rounded down
    listed = pairs.select("anchor_id", F.struct("slot", low.alias("low"), high.alias("high")).alias("w")).groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    windows = listed.select("anchor_id", F.transform("ws", lambda w: w["low"]).alias("lows"), F.transform("ws", lambda w: w["high"]).alias("highs"))
    mined = ask(anchors, index, groups, width, False, negatives, windows)
    return mined.select("anchor_id", "slot", F.explode("found").alias("f")).join(pairs, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("f.rank").cast("int").alias("rank"), F.col("f.id").alias("negative_id"),
        "positive_score", F.col("f.score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives with every seventh label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(embeddings.select("vec_id", "embedding", moved.alias("label"))))


SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW o AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER o <= 3"""
