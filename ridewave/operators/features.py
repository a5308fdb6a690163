"""Leakage-safe history features: lags, rolling windows, seasonal means, the feature table.

A bucket counts only when it has ended by the cutoff and its date is available at it.  A
covered bucket without events is 0, an uncovered one is NULL.  Counts stay sparse: the
zeros come from the coverage calendar, never from a dense entity x hour grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.functions.clock import bucket_start, calendar_columns, step, wall
from ridewave.operators.counts import available_dates, bucket_units


@dataclass(frozen=True)
class Policy:
    """Lags, windows and season of one horizon, in whole buckets."""

    name: str
    granularity: str
    suffix: str
    lags: tuple[int, ...]
    rolling: tuple[int, ...]
    season_step: int
    season_periods: int


# The three horizon policies.
DAY_HOUR = Policy("day/hour", "hourly", "h", (1, 2, 24, 48, 168), (24, 168), 24, 4)
MONTH_DAY = Policy("month/day", "daily", "d", (1, 7, 14, 364), (7, 28), 7, 4)
YEAR_MONTH = Policy("year/month", "monthly", "m", (1, 2, 3, 12), (3, 12), 12, 3)


def _ended(bucket: Column, granularity: str, cutoff: datetime) -> Column:
    return step(bucket, granularity, 1) <= wall(cutoff)


def look_back(targets: DataFrame, cells: DataFrame, coverage: DataFrame, entity: Sequence[str],
              policy: Policy, cutoff: datetime, offsets: Sequence[int]) -> DataFrame:
    """Value and unit ratio of every (target, offset): one join whatever the number of offsets."""
    asked = targets.select(*entity, "bucket", F.explode(F.array(*[F.lit(o) for o in sorted(set(offsets))])).alias("offset"))
    asked = asked.withColumn("source", step(F.col("bucket"), policy.granularity, -F.col("offset")))
    asked = asked.withColumn("_ended", _ended(F.col("source"), policy.granularity, cutoff))
    units = bucket_units(available_dates(coverage, cutoff), policy.granularity)
    asked = asked.withColumn("unit_day", F.to_date("source")).join(units, "unit_day", "left")
    found = asked.join(cells.select(*entity, F.col("bucket").alias("source"), "value"), [*entity, "source"], "left")
    covered = F.when(F.col("_ended"), F.coalesce(F.col("covered_units"), F.lit(0))).otherwise(F.lit(0))
    span = F.dayofmonth(F.last_day("source")) if policy.granularity == "monthly" else F.lit(1)
    return found.select(*entity, "bucket", "offset",
                        F.when(covered > 0, F.coalesce("value", F.lit(0))).alias("value"),
                        covered.alias("covered"), span.alias("span"))


def lag_features(targets: DataFrame, cells: DataFrame, coverage: DataFrame, entity: Sequence[str],
                 policy: Policy, cutoff: datetime) -> DataFrame:
    """Lag and same-phase columns per target bucket."""
    season = [policy.season_step * p for p in range(1, policy.season_periods + 1)]
    seen = look_back(targets, cells, coverage, entity, policy, cutoff, [*policy.lags, *season])
    monthly = policy.granularity == "monthly"

    def at(offset: int, c: str) -> Column:
        return F.max(F.when(F.col("offset") == offset, F.col(c)))

    columns: list[Column] = []
    for lag in policy.lags:
        columns.append(at(lag, "value").cast("double").alias(f"lag_{lag}{policy.suffix}"))
        if monthly:
            columns.append((at(lag, "covered") / at(lag, "span")).alias(f"lag_{lag}{policy.suffix}_units"))
    name = f"seasonal_{policy.season_periods}x{policy.season_step}{policy.suffix}"
    in_season = F.col("offset").isin(season)
    columns.append(F.avg(F.when(in_season, F.col("value"))).alias(f"{name}_mean"))
    columns.append((F.count(F.when(in_season, F.col("value"))) / policy.season_periods).alias(f"{name}_coverage"))
    if monthly:
        columns.append((F.sum(F.when(in_season, F.col("covered"))) / F.sum(F.when(in_season, F.col("span")))).alias(
            f"{name}_units"))
    return seen.groupBy(*entity, "bucket").agg(*columns)


def rolling_features(entities: DataFrame, cells: DataFrame, coverage: DataFrame, entity: Sequence[str],
                     policy: Policy, cutoff: datetime) -> DataFrame:
    """Sum, mean, max and coverage of the windows that end at the cutoff, per entity.

    Covered buckets are counted once from the calendar; cells with events add sum and max.
    """
    g = policy.granularity
    anchor = step(bucket_start(wall(cutoff), g), g, -1)
    known = bucket_units(available_dates(coverage, cutoff), g)
    per_unit = 24 if g == "hourly" else 1
    starts = known.where("covered_units > 0").select(
        F.col("unit_day"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_unit - 1)), lambda i: (
            F.col("unit_day").cast("timestamp_ntz") + F.make_dt_interval(hours=i)))).alias("bucket"))

    def inside(w: int) -> Column:
        return (F.col("bucket") > step(anchor, g, -w)) & (F.col("bucket") <= anchor)

    counts = starts.agg(*[F.count_if(inside(w)).alias(f"c{w}") for w in policy.rolling])
    sums = cells.where(inside(max(policy.rolling))).groupBy(*entity).agg(
        *[F.sum(F.when(inside(w), F.col("value"))).alias(f"s{w}") for w in policy.rolling],
        *[F.max(F.when(inside(w), F.col("value"))).alias(f"m{w}") for w in policy.rolling],
        *[F.count(F.when(inside(w), F.col("value"))).alias(f"k{w}") for w in policy.rolling])
    joined = entities.select(*entity).distinct().join(sums, list(entity), "left").join(counts, how="cross")
    columns: list[Column] = []
    for w in policy.rolling:
        n, name = F.col(f"c{w}"), f"roll_{w}{policy.suffix}"
        total = F.coalesce(F.col(f"s{w}"), F.lit(0)).cast("double")
        empty = n > F.coalesce(F.col(f"k{w}"), F.lit(0))
        top = F.when(empty, F.greatest(F.coalesce(F.col(f"m{w}"), F.lit(0)), F.lit(0))).otherwise(F.col(f"m{w}"))
        columns += [F.when(n > 0, total).alias(f"{name}_sum"), F.try_divide(total, n).alias(f"{name}_mean"),
                    F.when(n > 0, top).cast("double").alias(f"{name}_max"), (n / w).alias(f"{name}_coverage")]
    return joined.select(*entity, *columns)


def build_features(targets: DataFrame, cells: DataFrame, coverage: DataFrame, entity: Sequence[str],
                   policy: Policy, cutoff: datetime, capacities: DataFrame | None = None) -> DataFrame:
    """The feature table: calendar, horizon index, lags, rolling, season and known capacity."""
    from ridewave.functions.clock import wall_seconds

    calendar = calendar_columns(F.col("bucket"), policy.granularity)
    start = wall(cutoff)
    if policy.granularity == "hourly":
        index = ((wall_seconds(F.col("bucket")) - wall_seconds(start)) / 3600).cast("int")
    elif policy.granularity == "daily":
        index = F.datediff("bucket", start)
    else:
        index = ((F.year("bucket") - F.year(start)) * 12 + F.month("bucket") - F.month(start)).cast("int")
    base = targets.select(*entity, "bucket").select(
        "*", *[c.cast("double").alias(n) for n, c in calendar.items()], index.alias("horizon_index"))
    out = base.join(lag_features(targets, cells, coverage, entity, policy, cutoff), [*entity, "bucket"], "left")
    out = out.join(rolling_features(targets, cells, coverage, entity, policy, cutoff), list(entity), "left")
    if capacities is None:
        return out.withColumn("entity_capacity", F.lit(None).cast("double"))
    known = capacities.where(F.col("available_at") <= wall(cutoff)).groupBy(*entity).agg(
        F.max_by("capacity", "available_at").cast("double").alias("entity_capacity"))
    return out.join(known, list(entity), "left")


def route_hour_dataset(ledger: DataFrame, train_end, development_end) -> DataFrame:
    """Fixed-origin rows: lags of 24, 168 and 336 hours, the prior day and the date split.

    ``ledger`` has one row per observed (route, date, hour); a missing cell stays NULL.
    """
    def shifted(days: int, name: str) -> DataFrame:
        return ledger.select("route", F.date_add("date", days).alias("date"), "hour", F.col("boardings").alias(name))

    prior = ledger.groupBy("route", F.date_add("date", 1).alias("date")).agg(
        F.sum("boardings").alias("prior_day_sum"), F.count("boardings").alias("prior_day_observed_hours"))
    keys = ["route", "date", "hour"]
    out = ledger.join(shifted(1, "lag_24h"), keys, "left").join(shifted(7, "lag_168h"), keys, "left").join(
        shifted(14, "lag_336h"), keys, "left").join(prior, ["route", "date"], "left")
    split = (F.when(F.col("date") < F.lit(train_end), "train")
             .when(F.col("date") < F.lit(development_end), "development").otherwise("diagnostic"))
    return out.select(*keys, F.col("boardings").alias("target"), "lag_24h", "lag_168h", "lag_336h", "prior_day_sum",
                      F.coalesce("prior_day_observed_hours", F.lit(0)).alias("prior_day_observed_hours"),
                      F.weekday("date").alias("weekday"), split.alias("split"))
