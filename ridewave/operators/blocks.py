"""Ordered computations over keys of any size.

A plain window puts every row of its partition key into one task.  When one device or
route holds a third of all rows that task decides the run time, or dies.  The helpers
here cut a key into time blocks (or row blocks), run the ordinary window inside each
block, and carry what must cross a boundary through a small summary per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def with_block(df: DataFrame, second: str, seconds: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(second) / F.lit(seconds)).cast("bigint"))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], second: str,
                 values: Sequence[str], block_seconds: int = 3600, prefix: str = "prev_") -> DataFrame:
    """``lag(1)`` of ``values`` per key; the first row of a block takes the last row of the
    nearest earlier block that holds rows.  ``order`` starts with ``second``."""
    blocked = with_block(df, second, block_seconds)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    payload = F.struct(*[F.col(v) for v in values])
    rows = blocked.withColumn("_prev", F.lag(payload).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1)
    tails = blocked.groupBy(*keys, BLOCK).agg(
        F.max_by(payload, F.struct(*[F.col(o) for o in order])).alias("_tail"))
    carry = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(BLOCK))).drop("_tail")
    joined = rows.join(carry, [*keys, BLOCK], "left")
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return joined.withColumn("_prev", chosen).select(
        *df.columns, *[F.col("_prev")[v].alias(prefix + v) for v in values])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], second: str,
                value: str, name: str, block_seconds: int = 3600) -> DataFrame:
    """Running total of ``value`` per key in ``order``: block totals first, then inside blocks."""
    blocked = with_block(df, second, block_seconds)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_total")).withColumn(
        "_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return blocked.join(totals, [*keys, BLOCK], "left").select(
        *df.columns, (F.sum(value).over(inner) + F.col("_base")).alias(name))


def running_sums(df: DataFrame, keys: Sequence[str], second: str, values: Sequence[str], block_seconds: int = 86400) -> DataFrame:
    """Running totals of several columns per key, one row a second, in their own places."""
    blocked = with_block(df, second, block_seconds)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(second).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias("_" + v) for v in values])
    bases = totals.select(*keys, BLOCK, *[F.coalesce(F.sum("_" + v).over(before), F.lit(0)).alias("_" + v) for v in values])
    return blocked.join(bases, [*keys, BLOCK]).select(*[
        (F.sum(x).over(inner) + F.col("_" + x)).alias(x) if x in values else F.col(x) for x in df.columns])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], second: str,
              name: str = "row_index", block_seconds: int = 3600) -> DataFrame:
    """Zero-based position per key in ``order``."""
    numbered = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, second,
                           "_one", name, block_seconds)
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def with_halo(df: DataFrame, position: str, size: int, before: int, after: int) -> DataFrame:
    """Copy rows into every block whose bounded window may look at them.

    A window reaching ``before`` back and ``after`` forward of rows owned by a block is then
    complete inside the block; keep rows where ``owned`` afterwards.  Each row is copied at
    most ``1 + ceil(before/size) + ceil(after/size)`` times.
    """
    own = F.floor(F.col(position) / F.lit(size)).cast("bigint")
    first = F.floor((F.col(position) - F.lit(after)) / F.lit(size)).cast("bigint")
    last = F.floor((F.col(position) + F.lit(before)) / F.lit(size)).cast("bigint")
    return (
        df.withColumn("_own", own)
        .withColumn(BLOCK, F.explode(F.sequence(first, last)))
        .withColumn("owned", F.col(BLOCK) == F.col("_own"))
        .drop("_own")
    )


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_second: str,
                  right_second: str, values: Sequence[str], tie: Sequence[str] = (),
                  block_seconds: int = 3600, inclusive: bool = True) -> DataFrame:
    """Last right row with ``right_second <= left_second`` per key (``<`` when not inclusive).

    Among right rows of one second the largest ``tie`` wins.  Values arrive as ``right_*``;
    they are NULL when nothing precedes.
    """
    payload = F.struct(F.col(right_second).alias("second"), *[F.col(t).alias("t_" + t) for t in tie],
                       *[F.col(v).alias("v_" + v) for v in values])
    rank = F.lit(0 if inclusive else 1)
    marks = right.select(*keys, F.col(right_second).cast("bigint").alias("_s"), rank.alias("_side"),
                         payload.alias("_mark"), F.lit(None).cast(
                             left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    rows = left.select(*keys, F.col(left_second).cast("bigint").alias("_s"),
                       F.lit(1 if inclusive else 0).alias("_side"),
                       F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_mark"),
                       F.struct(*left.columns).alias("_row"))
    both = with_block(marks.unionByName(rows), "_s", block_seconds)
    inner = Window.partitionBy(*keys, BLOCK).orderBy("_s", "_side", "_mark").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_mark", ignorenulls=True).over(inner))
    back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*keys, BLOCK).agg(F.max("_mark").alias("_tail")).withColumn(
        "_carry", F.last("_tail", ignorenulls=True).over(back)).drop("_tail")
    out = seen.where(F.col("_row").isNotNull()).join(carry, [*keys, BLOCK], "left")
    found = F.coalesce("_seen", "_carry")
    return out.withColumn("_found", found).select(
        "_row.*", F.col("_found.second").alias("right_second"),
        *[F.col("_found.v_" + v).alias("right_" + v) for v in values])


def met_marks(left: DataFrame, marks: DataFrame, keys: Sequence[str], left_second: str, at: str, sums: Sequence[str] = (),
              near: Sequence[str] = (), block_seconds: int = 86400) -> DataFrame:
    """What each left row meets among marks of its key, in one pass: totals of ``sums`` over the marks ``at`` or before its second
    (0 when there are none), and of ``near`` (seconds like ``at``) the closest at or before, ``*_back``, and at or after, ``*_next``.

    Rows and marks move once, and each input is read twice, however many kinds of marks there are.
    """
    held = marks.select(*keys, F.col(at).cast("bigint").alias("_s"), F.lit(0).alias("_side"), *sums, *near)
    rows = left.select(*keys, F.col(left_second).cast("bigint").alias("_s"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = with_block(held.unionByName(rows, allowMissingColumns=True), "_s", block_seconds)
    inner, across = Window.partitionBy(*keys, BLOCK), Window.partitionBy(*keys)
    until = inner.orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = inner.orderBy(F.desc("_s"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = across.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    inside = [*[F.sum(x).over(until).alias("i_" + x) for x in sums], *[F.max(x).over(until).alias("i_" + x + "_back") for x in near],
              *[F.min(x).over(since).alias("i_" + x + "_next") for x in near]]
    seen = both.select(*keys, BLOCK, "_row", *inside).where(F.col("_row").isNotNull())
    blocks = both.groupBy(*keys, BLOCK).agg(*[F.sum(x).alias(x) for x in sums], *[F.max(x).alias(x + "_back") for x in near],
                                            *[F.min(x).alias(x + "_next") for x in near])
    carry = blocks.select(*keys, BLOCK, *[F.sum(x).over(before).alias("c_" + x) for x in sums],
                          *[F.max(x + "_back").over(before).alias("c_" + x + "_back") for x in near],
                          *[F.min(x + "_next").over(after).alias("c_" + x + "_next") for x in near])
    zero = F.lit(0)
    return seen.join(carry, [*keys, BLOCK], "left").select(
        "_row.*", *[(F.coalesce("i_" + x, zero) + F.coalesce("c_" + x, zero)).alias(x) for x in sums],
        *[F.coalesce("i_" + x + side, "c_" + x + side).alias(x + side) for x in near for side in ("_back", "_next")])


def nearest_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], left_second: str,
                     right_second: str, name: str = "distance", block_seconds: int = 3600) -> DataFrame:
    """Distance to the closest earlier or later right clock of the key (NULL when it has none)."""
    marks = right.select(*keys, F.col(right_second).alias("_clock"))
    met = met_marks(left, marks, keys, left_second, "_clock", near=["_clock"], block_seconds=block_seconds)
    gap = F.least(F.col(left_second) - F.col("_clock_back"), F.col("_clock_next") - F.col(left_second))
    return met.withColumn(name, gap).select(*left.columns, name)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Interpolated quantiles from value frequencies.

    Equal values are counted before the shuffle, so the buffer of a hot group grows with the
    distinct values (whole seconds, counts) and not with its rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_freq"))
    return counted.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(q), F.col("_freq")).alias(n) for n, q in quantiles.items()], *extra)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], second: str, value: str, name: str,
               block_seconds: int = 86400) -> DataFrame:
    """Last non-NULL ``value`` up to each row per key, carried across blocks."""
    blocked = with_block(df, second, block_seconds)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocked.withColumn("_seen", F.last(value, ignorenulls=True).over(inner))
    position = F.struct(*[F.col(o) for o in order])
    tails = blocked.groupBy(*keys, BLOCK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_tail"))
    back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(back)).drop("_tail")
    return rows.join(carry, [*keys, BLOCK], "left").select(
        *df.columns, F.coalesce("_seen", "_carry").alias(name))
