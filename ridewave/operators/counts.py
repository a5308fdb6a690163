"""Counts, coverage, ledgers and audits of validation events."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.functions.clock import bucket_start, wall
from ridewave.operators.blocks import previous_row
from ridewave.operators.joins import checked



def hourly_counts(events: DataFrame, route: str = "route", ts: str = "ts") -> DataFrame:
    """Successful events per route, date and hour (combined before the shuffle)."""
    return events.where("success").groupBy(
        F.col(route).alias("route"), F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("boardings"))


def available_dates(coverage: DataFrame, cutoff=None) -> DataFrame:
    """Covered dates with ``available``: published by the cutoff, or without a stamp."""
    if cutoff is None:
        return coverage.select("date", F.lit(True).alias("available"))
    seen = F.col("published_at").isNull() | (F.col("published_at") <= wall(cutoff))
    return coverage.select("date", seen.alias("available"))


def bucket_counts(events: DataFrame, entity: Sequence[str], granularity: str, coverage: DataFrame,
                  cutoff=None, ts: str = "ts") -> DataFrame:
    """Sparse counts per entity and calendar bucket with covered and total dates.

    An event on a date the calendar does not cover stops the run.  Dates not yet available at
    the cutoff are left out, so their buckets are missing rather than short.
    """
    daily = events.groupBy(*entity, F.to_date(ts).alias("date"), bucket_start(F.col(ts), granularity).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    known = available_dates(coverage, cutoff)
    seen = checked(F.col("available"), F.col("available").isNull() & F.col("n").isNotNull(),
                   "coverage calendar excludes a date that has events", "boolean")
    counts = daily.join(known, "date", "left").where(seen).groupBy(*entity, "bucket").agg(F.sum("n").alias("value"))
    units = bucket_units(known, granularity)
    day_key = F.to_date("bucket")
    keyed = counts.withColumn("unit_day", day_key)
    return keyed.join(units, "unit_day", "left").drop("unit_day")


def bucket_units(known: DataFrame, granularity: str) -> DataFrame:
    """Available and total civil dates of each bucket, keyed by the bucket's first date."""
    if granularity == "monthly":
        first = F.trunc("date", "month")
        return known.groupBy(first.alias("unit_day")).agg(
            F.count_if("available").alias("covered_units"),
            F.max(F.dayofmonth(F.last_day("date"))).cast("bigint").alias("total_units"))
    return known.select(F.col("date").alias("unit_day"), F.col("available").cast("bigint").alias("covered_units"),
                        F.lit(1).cast("bigint").alias("total_units"))


def forecast_buckets(origins: DataFrame, horizon: str, column: str = "origin") -> DataFrame:
    """Buckets of a calendar horizon: 24 elapsed hours, the days of a month, 12 months.

    A misaligned origin gives one row with ``problem`` and no bucket.
    """
    at = F.col(column)
    day = F.to_date(at)
    off_hour = (F.minute(at) != 0) | (F.second(at) != 0)
    off_month = (F.dayofmonth(day) != 1) | (F.hour(at) != 0)
    problem = F.when(off_hour, "origin must align to an exact hour")
    if horizon in ("month", "year"):
        problem = problem.when(off_month, "month and year origins start a month at midnight")
    if horizon == "year":
        problem = problem.when(F.month(day) != 1, "year origin must be January 1")
    if horizon == "day":
        starts = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: at + F.make_dt_interval(hours=i))
        end = lambda s: s + F.make_dt_interval(hours=F.lit(1))
    elif horizon == "month":
        starts = F.transform(F.sequence(day, F.last_day(day)), lambda d: d.cast("timestamp_ntz"))
        end = lambda s: F.date_add(F.to_date(s), 1).cast("timestamp_ntz")
    elif horizon == "year":
        starts = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.add_months(day, m).cast("timestamp_ntz"))
        end = lambda s: F.add_months(F.to_date(s), 1).cast("timestamp_ntz")
    else:
        raise ValueError(f"unsupported horizon {horizon!r}")
    marked = origins.withColumn("problem", problem)
    return marked.withColumn("bucket_start", F.explode_outer(F.when(F.col("problem").isNull(), starts))).withColumn(
        "bucket_end", end(F.col("bucket_start")))


def covered_prefix(known: DataFrame, granularity: str) -> DataFrame:
    """Running number of covered buckets before each bucket of the calendar."""
    from pyspark.sql import Window

    units = bucket_units(known, granularity)
    w = Window.orderBy("unit_day").rowsBetween(Window.unboundedPreceding, -1)
    # one row per calendar bucket of the whole system: thousands of rows, not data
    return units.select("unit_day", (F.col("covered_units") > 0).alias("covered"),
                        F.coalesce(F.sum((F.col("covered_units") > 0).cast("bigint")).over(w), F.lit(0)).alias(
                            "covered_before"))


def relation_spans(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """First, last, success and rejected counts per hour and identity tuple."""
    return events.groupBy(bucket_start(F.col(ts), "hourly").alias("event_hour"), *keys).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("rejected"))


def identity_conflicts(relations: DataFrame) -> DataFrame:
    """Devices on several vehicles, vehicles on several route:exit pairs, migrating devices."""
    def conflicts(keys: Sequence[str], value: Column, name: str) -> DataFrame:
        per = relations.groupBy(*keys).agg(F.count_distinct(value).alias("n"))
        return per.where("n > 1").agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("conflicts"))

    pair = F.concat_ws(":", F.col("route").cast("string"), F.col("exit").cast("string"))
    return (conflicts(["event_hour", "device"], F.col("vehicle"), "device_hours")
            .unionByName(conflicts(["event_hour", "vehicle"], pair, "vehicle_hours"))
            .unionByName(conflicts(["device"], F.col("vehicle"), "device_migrations")))


def mass_ledger(events: DataFrame, statuses: Sequence[str], keys: Sequence[str] = ("route", "date", "hour")) -> DataFrame:
    """Source mass of each key and its split over assignment statuses."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_success"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def check_mass(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose mass differs by more than the tolerance; a missing key counts as zero."""
    both = left.select(*keys, F.col(value).alias("left_mass")).join(
        right.select(*keys, F.col(value).alias("right_mass")), list(keys), "full")
    gap = F.coalesce("left_mass", F.lit(0.0)) - F.coalesce("right_mass", F.lit(0.0))
    return both.withColumn("difference", gap).where(F.abs("difference") > tolerance)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: dict[str, Column]) -> DataFrame:
    """Several groupings in one pass; ``dimension`` names the set, ``member`` its value."""
    axes = [F.struct(F.lit("+".join(s) or "overall").alias("dimension"),
                     F.concat_ws("/", *[F.col(c).cast("string") for c in s]).alias("member")) for s in sets]
    return df.withColumn("_axis", F.explode(F.array(*axes))).groupBy("_axis.dimension", "_axis.member").agg(
        *[a.alias(n) for n, a in aggregates.items()])


def label_profile(labels: DataFrame) -> DataFrame:
    """Route x month, day, hour and weekday rollups of labels."""
    enriched = labels.select("*", F.date_format("date", "yyyy-MM").alias("month"),
                             F.weekday("date").alias("weekday"))
    return grouping_sets(enriched, [["route", "month"], ["date"], ["hour"], ["weekday"]], {
        "rows": F.count(F.lit(1)), "total": F.sum("boardings"), "days": F.count_distinct("date"),
        "positive": F.count_if(F.col("boardings") > 0), "highest": F.max("boardings")})


def zero_days(labels: DataFrame) -> DataFrame:
    return labels.groupBy("route", "date").agg(F.sum("boardings").alias("total")).where("total = 0").select(
        "route", "date")


def raw_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts per column, NULL included, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias(
        "value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def time_quality(events: DataFrame, source_order: str, second: str = "sec") -> DataFrame:
    """Clock steps back in source order, same-second repeats, seconds shared by devices or vehicles."""
    ordered = previous_row(events.withColumn("_order", F.col(source_order)), ["device"], ["_order"], "_order",
                           [second], block_seconds=100_000, prefix="prev_")
    back = ordered.agg(F.count_if(F.col("prev_" + second) > F.col(second)).alias("n"))
    per_device = events.groupBy("device", second).agg(F.count(F.lit(1)).alias("c"))
    repeat = per_device.agg(F.coalesce(F.sum(F.greatest(F.col("c") - 1, F.lit(0))), F.lit(0)).alias("n"))
    shared = events.groupBy("vehicle", second).agg(F.count_distinct("device").alias("d")).agg(
        F.count_if(F.col("d") > 1).alias("n"))
    multi = events.groupBy(second).agg(F.count_distinct("vehicle").alias("v")).agg(F.count_if(F.col("v") > 1).alias("n"))
    names = ("negative_gaps", "same_second_excess", "vehicle_seconds_with_devices", "seconds_with_vehicles")
    frames = [f.select(F.lit(n).alias("measure"), F.col("n").cast("bigint").alias("value"))
              for n, f in zip(names, (back, repeat, shared, multi), strict=True)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# Buckets a policy reads back and forecasts ahead, per granularity.
POLICY_REACH = {"hourly": (168, 24), "daily": (364, 31), "monthly": (36, 12)}


def supportability(events: DataFrame, entity: Sequence[str], min_ratio: float = 0.9, ts: str = "ts") -> DataFrame:
    """Whole buckets inside the observed span against history plus target, with blockers."""
    spans = events.groupBy(*entity).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count_distinct(F.to_date(ts)).alias("observed_dates"))
    first, last = F.col("first"), F.col("last")
    d0, d1 = F.to_date(first), F.to_date(last)
    exact_hour = bucket_start(first, "hourly") == first
    midnight = d0.cast("timestamp_ntz") == first
    hours = (F.datediff(d1, d0) * 24 + F.hour(last) - F.hour(first) - F.when(exact_hour, 0).otherwise(1))
    days = F.datediff(d1, d0) - F.when(midnight, 0).otherwise(1)
    months = ((F.year(d1) - F.year(d0)) * 12 + F.month(d1) - F.month(d0)
              - F.when(midnight & (F.dayofmonth(d0) == 1), 0).otherwise(1))
    whole = {"hourly": hours, "daily": days, "monthly": months}
    rows = F.array(*[F.struct(
        F.lit(g).alias("granularity"), F.greatest(whole[g], F.lit(0)).cast("bigint").alias("complete_buckets"),
        F.lit(a + b).cast("bigint").alias("required_buckets")) for g, (a, b) in POLICY_REACH.items()])
    ratio = F.col("observed_dates") / (F.datediff(d1, d0) + 1)
    out = spans.withColumn("coverage_ratio", ratio).withColumn("_g", F.explode(rows)).select(
        *entity, "_g.*", "coverage_ratio")
    blockers = F.array_compact(F.array(
        F.when(F.col("complete_buckets") < F.col("required_buckets"), "insufficient_history"),
        F.when(F.col("coverage_ratio") < min_ratio, "sparse_coverage")))
    return out.withColumn("blockers", F.array_join(blockers, ";")).withColumn(
        "supportable", F.size(blockers) == 0)
