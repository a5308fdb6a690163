"""Detectors of demand shifts before a forecast origin, and known limits of a forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LevelPolicy:
    """Defaults of the level detector."""

    recent_days: int = 14
    reference_days: int = 28
    ratio: float = 1.3
    min_reference_daily: float = 20.0
    min_reference_days: int = 20
    min_week_days: int = 5


@dataclass(frozen=True)
class ShapePolicy:
    """Defaults of the hour-shape detector."""

    recent_days: int = 28
    reference_days: int = 56
    min_reference_days: int = 40
    min_half_days: int = 10
    min_reference_daily: float = 20.0
    total_variation: float = 0.05
    min_alignment: float = 0.5


def _origin_rows(labels: DataFrame, origins: Sequence[date], days: int) -> DataFrame:
    lits = F.array(*[F.lit(o) for o in origins])
    return labels.withColumn("origin", F.explode(F.filter(
        lits, lambda o: (F.col("date") < o) & (F.col("date") >= F.date_sub(o, days)))))


def level_shifts(labels: DataFrame, origins: Sequence[date], policy: LevelPolicy = LevelPolicy(),
                 exceptions: Sequence[date] = ()) -> DataFrame:
    """Routes whose two latest weeks both left their weekday-matched reference, per origin.

    A route counts only with every day of the span present and complete (24 hours).
    """
    c, span = F.col, policy.recent_days + policy.reference_days
    daily = _origin_rows(labels, origins, span).groupBy("origin", "route", "date").agg(
        F.sum("boardings").cast("double").alias("total"), F.count_distinct("hour").alias("hours"))
    whole = daily.groupBy("origin", "route").agg(
        F.count(F.lit(1)).alias("_d"), F.min("hours").alias("_h")).where((c("_d") == span) & (c("_h") == 24))
    normal = daily.join(whole.select("origin", "route"), ["origin", "route"], "left_semi").withColumn("weekday", F.weekday("date"))
    if exceptions:
        normal = normal.where(~c("date").isin(list(exceptions)))
    age = F.datediff("origin", "date")
    reference = normal.where(age > policy.recent_days)
    by_weekday = reference.groupBy("origin", "route", "weekday").agg(F.avg("total").alias("expected"))
    support = reference.groupBy("origin", "route").agg(F.count(F.lit(1)).alias("_ref"))
    recent = normal.where(age <= policy.recent_days).join(by_weekday, ["origin", "route", "weekday"], "left")
    first = age > 7
    g = recent.groupBy("origin", "route").agg(
        F.count_if(c("expected").isNull()).alias("unmatched"), F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"),
        F.avg("expected").alias("reference"), F.avg("total").alias("recent"),
        F.try_divide(F.sum(F.when(first, c("total"))), F.sum(F.when(first, c("expected")))).alias("r1"),
        F.try_divide(F.sum(F.when(~first, c("total"))), F.sum(F.when(~first, c("expected")))).alias("r2"),
        F.try_divide(F.sum("total"), F.sum("expected")).alias("value")).join(support, ["origin", "route"])
    usable = g.where((c("_ref") >= policy.min_reference_days) & (c("unmatched") == 0) & (c("n1") >= policy.min_week_days)
                     & (c("n2") >= policy.min_week_days) & (c("reference") >= policy.min_reference_daily))
    low, high = F.least("r1", "r2", "value"), F.greatest("r1", "r2", "value")
    direction = F.when(low >= policy.ratio, "up").when(high <= 1 / policy.ratio, "down")
    return usable.withColumn("direction", direction).where("direction IS NOT NULL").select(
        "origin", "route", F.lit("demand_level").alias("kind"), "direction", "value", "recent", "reference")


def shape_shifts(labels: DataFrame, origins: Sequence[date], policy: ShapePolicy = ShapePolicy(),
                 exceptions: Sequence[date] = ()) -> DataFrame:
    """Routes whose hour shares moved the same way in both recent halves, per origin."""
    c, span = F.col, policy.recent_days + policy.reference_days
    rows = _origin_rows(labels, origins, span)
    whole = rows.groupBy("origin", "route").agg(
        F.count_distinct("date").alias("_d"), F.count(F.lit(1)).alias("_n")).where(
        (c("_d") == span) & (c("_n") == span * 24)).select("origin", "route")
    normal = rows.join(whole, ["origin", "route"], "left_semi")
    if exceptions:
        normal = normal.where(~c("date").isin(list(exceptions)))
    age = F.datediff("origin", "date")
    part = F.when(age > policy.recent_days, "ref").when(age > policy.recent_days // 2, "a").otherwise("b")
    hourly = normal.groupBy("origin", "route", "hour").agg(*[
        F.sum(F.when(part == p, c("boardings"))).cast("double").alias(p) for p in ("ref", "a", "b")])
    days = normal.groupBy("origin", "route").agg(*[
        F.count_distinct(F.when(part == p, c("date"))).alias("d_" + p) for p in ("ref", "a", "b")])
    totals = hourly.groupBy("origin", "route").agg(*[F.sum(p).alias("t_" + p) for p in ("ref", "a", "b")])
    s = {p: F.try_divide(p, "t_" + p) for p in ("ref", "a", "b")}
    both = F.try_divide(c("a") + c("b"), c("t_a") + c("t_b"))
    da, db = s["a"] - s["ref"], s["b"] - s["ref"]
    g = hourly.join(totals, ["origin", "route"]).groupBy("origin", "route", "t_ref", "t_a", "t_b").agg(
        (F.sum(F.abs(da)) / 2).alias("tv_a"), (F.sum(F.abs(db)) / 2).alias("tv_b"),
        (F.sum(F.abs(both - s["ref"])) / 2).alias("distance"), F.sum(da * db).alias("dot"),
        F.sqrt(F.sum(da * da)).alias("na"), F.sqrt(F.sum(db * db)).alias("nb")).join(days, ["origin", "route"])
    alignment = F.coalesce(F.try_divide("dot", c("na") * c("nb")), F.lit(0.0))
    daily_ref = c("t_ref") / c("d_ref")
    fit = ((c("d_ref") >= policy.min_reference_days) & (c("d_a") >= policy.min_half_days) & (c("d_b") >= policy.min_half_days)
           & (daily_ref >= policy.min_reference_daily) & (c("t_a") > 0) & (c("t_b") > 0)
           & (F.least("tv_a", "tv_b", "distance") >= policy.total_variation) & (alignment >= policy.min_alignment))
    return g.where(fit).select(
        "origin", "route", F.lit("hour_shape").alias("kind"), F.lit("changed").alias("direction"), c("distance").alias("value"),
        ((c("t_a") + c("t_b")) / (c("d_a") + c("d_b"))).alias("recent"), daily_ref.alias("reference"))


def assess_limits(history: DataFrame, origin: date, horizon: int, signals: DataFrame, clip: tuple[float, float],
                  model_bound: float) -> DataFrame:
    """Known gaps: unseen target months, routes without demand, shifts beyond clip or model bound."""
    c = F.col
    months = sorted({(origin + timedelta(days=i)).month for i in range(horizon)})
    wanted = history.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
    seen = history.select(F.month("date").alias("month")).distinct()

    def flag(df: DataFrame, name: str, entity: Column, value: Column | None = None, bound: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("double")
        return df.select(F.lit(name).alias("flag"), entity.cast("string").alias("entity"),
                         (none if value is None else value).alias("value"), (none if bound is None else bound).alias("bound"))

    unseen = flag(wanted.join(seen, "month", "left_anti"), "unseen_target_month", c("month"))
    idle = history.groupBy("route").agg(F.sum("boardings").alias("t")).where("t = 0")
    level = signals.where("kind = 'demand_level'")
    low, high = clip
    clipped = level.where((c("value") > high) | (c("value") < low))
    beyond = level.where(F.abs(c("value") - 1) > model_bound)
    return (unseen.unionByName(flag(idle, "no_observed_route_demand", c("route")))
            .unionByName(flag(clipped, "trend_input_clipped", c("route"), c("value"),
                              F.when(c("direction") == "up", F.lit(high)).otherwise(F.lit(low))))
            .unionByName(flag(beyond, "ml_bound_below_observed_change", c("route"), F.abs(c("value") - 1), F.lit(model_bound))))
