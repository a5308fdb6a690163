"""Grids, checked joins, reconciliation, versions and interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_grid(entities: DataFrame, days: DataFrame) -> DataFrame:
    """Every entity on every day and hour.  Both inputs are dimensions, one row per member;
    the product is the dense calendar the forecasts are made of."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    return entities.distinct().join(days.distinct(), how="cross").select("*", hours)


def day_range(spark, start, end) -> DataFrame:
    """One row per civil date of a closed range."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def span_days(df: DataFrame, column: str = "date") -> DataFrame:
    """Every civil date between the first and last date of a table."""
    return df.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("date"))


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fail the job at the first row where ``bad`` holds; otherwise pass rows through.

    Do not filter the same outer join on the checked column afterwards: a null-rejecting filter
    turns the join inner and removes the rows the guard must see.  Use :func:`checked` there.
    """
    guard = F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)


def checked(value: Column, bad: Column, message: str, kind: str) -> Column:
    """The value, or a failed job where ``bad`` holds; the guard travels with the value.

    ``bad`` names columns of both join sides, which keeps the optimizer from reasoning about one.
    """
    return F.when(bad, F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unique_side(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The table with a guard that fails when a key repeats."""
    values = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(v).alias(v) for v in values])
    return require(packed, F.col("_copies") > 1, message).select(*df.columns)


def merge_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    return left.join(unique_side(right, keys, "right side repeats a key"), list(keys), "left")


def complete_labels(labels: DataFrame, grid: DataFrame, keys: Sequence[str], value: str,
                    missing_as_zero: bool = False) -> DataFrame:
    """Dense labels.  Duplicate keys, keys outside the grid, negative or fractional counts and
    (unless zero filling is proven) missing keys stop the run."""
    grouped = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(value).alias(value))
    marked = grid.select(*keys).withColumn("_grid", F.lit(True)).join(grouped, list(keys), "full")
    checked = require(marked, F.col("_n") > 1, "duplicate label keys")
    checked = require(checked, F.col("_grid").isNull(), "label keys outside the grid")
    number = F.col(value).cast("double")
    checked = require(checked, (number < 0) | (number != F.floor(number)) | F.isnan(number),
                      "boardings must be finite nonnegative integers")
    if not missing_as_zero:
        checked = require(checked, F.col("_n").isNull(), "label keys missing")
    return checked.select(*keys, F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias(value))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Totals of a full outer comparison: only left, only right, changed, equal."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, list(keys), "full")
    in_a, in_b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(
        F.count_if(in_a & ~in_b).alias("left_only"),
        F.count_if(in_b & ~in_a).alias("right_only"),
        F.count_if(in_a & in_b & ~same).alias("changed"),
        F.count_if(in_a & in_b & same).alias("equal"),
        F.coalesce(F.sum("_a"), F.lit(0)).cast("bigint").alias("left_total"),
        F.coalesce(F.sum("_b"), F.lit(0)).cast("bigint").alias("right_total"),
    )


def grid_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only")))


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of the intersection, union and differences of two key sets in one aggregation."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
        F.count(F.lit(1)).alias("either"),
    )


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as an aggregate (map-side combined)."""
    pick = F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def asof_version(versions: DataFrame, keys: Sequence[str], origin: Column, end: Column,
                 tie: Sequence[str] = ()) -> DataFrame:
    """Newest version published before ``origin`` whose validity covers ``[origin, end]``;
    an entity whose chosen version is inactive is left out."""
    usable = versions.where(
        (F.col("available_at") < origin) & (F.col("valid_from") <= origin) & (F.col("valid_to") >= end))
    values = [c for c in versions.columns if c not in keys]
    return latest(usable, keys, ["available_at", *tie], values).where("active")


def daily_versions(edits: DataFrame, entity: str, identity: str, at: str,
                   tie: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest edit per entity and local day; when the entity moves to another identity the old
    identity gets an inactive row on the day of the move."""
    day = edits.withColumn("day", F.to_date(at))
    newest = latest(day, [entity, "day"], [at, *tie], [identity, *values])
    # one row per entity and day: bounded by the calendar, so a plain window is safe
    w = Window.partitionBy(entity).orderBy("day")
    moved = newest.withColumn("_old", F.lag(identity).over(w))
    active = moved.select(entity, "day", identity, *values, F.lit(True).alias("active"))
    gone = moved.where(F.col("_old").isNotNull() & (F.col("_old") != F.col(identity))).select(
        entity, "day", F.col("_old").alias(identity), *values, F.lit(False).alias("active"))
    return active.unionByName(gone)


def range_join(events: DataFrame, intervals: DataFrame, keys: Sequence[str], second: str,
               start: str, end: str, bucket: int = 900, how: str = "inner",
               inclusive_end: bool = False) -> DataFrame:
    """Intervals that contain an event, joined on ``keys`` and a time bucket.

    An interval is copied into each bucket it touches, an event sits in one bucket, so the
    join is an equi join and every pair appears once.
    """
    last = F.col(end) if inclusive_end else F.col(end) - F.lit(1)
    cut = intervals.where(last >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col(start) / bucket).cast("bigint"), F.floor(last / bucket).cast("bigint"))))
    marked = events.withColumn("_bucket", F.floor(F.col(second) / bucket).cast("bigint"))
    upper = F.col(second) <= F.col(end) if inclusive_end else F.col(second) < F.col(end)
    condition = reduce(lambda x, y: x & y, [
        *[marked[k] == cut[k] for k in [*keys, "_bucket"]],
        F.col(second) >= F.col(start), upper])
    joined = marked.join(cut, condition, how)
    return joined.select(*[marked[c] for c in events.columns],
                         *[cut[c] for c in intervals.columns if c not in keys])


def asof_snapshot(observations: DataFrame, snapshots: DataFrame, origins: Sequence,
                  content: Sequence[str]) -> DataFrame:
    """Content of the snapshot named by the last observation seen at or before each origin.

    The last *observation* decides, so content that changed A -> B -> A reads as A again.
    """
    wanted = F.array(*[F.lit(o) for o in origins])
    seen = observations.withColumn(
        "origin", F.explode(F.filter(wanted, lambda o: o >= F.col("available_at"))))
    chosen = seen.groupBy("origin", "source_id").agg(
        F.max_by("snapshot_id", F.struct("available_at", "observation_id")).alias("snapshot_id"))
    return chosen.join(snapshots.select("snapshot_id", *content), "snapshot_id", "left")
