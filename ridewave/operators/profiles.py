"""Calendar profiles: means, medians, levels, shares and their reducers.

Every profile is a roll-up of one small statistics table (entity x calendar key), so the
label history is read and shuffled once however many windows and keys are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.functions.clock import day_type
from ridewave.operators.blocks import exact_quantiles
from ridewave.operators.joins import require


@dataclass(frozen=True)
class Calendar:
    """Civil dates whose day type differs from their weekday."""

    off: tuple[date, ...] = ()
    work: tuple[date, ...] = ()


def with_calendar(df: DataFrame, calendar: Calendar = Calendar()) -> DataFrame:
    exceptions = [*calendar.off, *calendar.work]
    return df.select(
        "*", F.weekday("date").alias("dow"), F.month("date").isin(6, 7, 8).cast("int").alias("season"),
        day_type(F.col("date"), calendar.off, calendar.work).alias("day_type"),
        (F.col("date").isin(exceptions) if exceptions else F.lit(False)).cast("int").alias("exception"))


def assert_before(df: DataFrame, origin: date, column: str = "date") -> DataFrame:
    """Fail when history reaches the forecast origin."""
    return require(df, F.col(column) >= F.lit(origin), "history reaches the forecast origin")


def history_before(df: DataFrame, origin: date) -> DataFrame:
    return df.where(F.col("date") < F.lit(origin))


def recent(origin: Column | date, days: int) -> Column:
    """Within the last ``days`` before the origin (0: all history)."""
    at = F.lit(origin) if isinstance(origin, date) else origin
    return F.lit(True) if days == 0 else F.col("date") >= F.date_sub(at, days)


CALENDAR_KEYS = ("season", "dow", "day_type", "hour")


def profile_stats(history: DataFrame, origin: Column | date, windows: Iterable[int],
                  calendar: Calendar = Calendar(), entity: Sequence[str] = ("route",),
                  value: str = "boardings", extra: Sequence[str] = ()) -> DataFrame:
    """Sum and count per entity and calendar key for every window, in one aggregation."""
    aggregates = []
    for w in windows:
        chosen = F.when(recent(origin, w), F.col(value))
        aggregates += [F.sum(chosen).alias(f"s{w}"), F.count(chosen).alias(f"n{w}")]
    return with_calendar(history, calendar).groupBy(*extra, *entity, *CALENDAR_KEYS).agg(*aggregates)


def roll_up(stats: DataFrame, keys: Sequence[str], window: int, name: str, support: str | None = None) -> DataFrame:
    """Mean per key from the statistics table; keys without observations are absent."""
    total, n = F.sum(f"s{window}"), F.sum(f"n{window}")
    out = stats.groupBy(*keys).agg((total / F.nullif(n, F.lit(0))).alias(name), n.alias("_n"))
    kept = out.where("_n > 0")
    return kept.withColumnRenamed("_n", support) if support else kept.drop("_n")


# Profile name -> (keys after the entity, window in days, 0 = all history).
PROFILES: dict[str, tuple[tuple[str, ...], int]] = {
    "route_hour_28": (("hour",), 28), "route_day_28": ((), 28),
    "route_hour_56": (("hour",), 56), "route_day_56": ((), 56),
    "route_hour_all": (("hour",), 0), "route_dow_hour_84": (("dow", "hour"), 84),
    "route_dow_hour_all": (("dow", "hour"), 0), "route_hour_last_week": (("dow", "hour"), 7),
    "route_dow_hour_same_season": (("season", "dow", "hour"), 0),
    "route_hour_same_season": (("season", "hour"), 0),
    "route_day_type_hour_same_season": (("season", "day_type", "hour"), 0),
}
SUPPORTS = {"route_dow_hour_same_season": "same_season_support",
            "route_day_type_hour_same_season": "day_type_support"}


def profile_means(history: DataFrame, origin: date, profile: str, entity: Sequence[str] = ("route",),
                  calendar: Calendar = Calendar(), window: int | None = None) -> DataFrame:
    keys, default = PROFILES[profile]
    days = default if window is None else window
    stats = profile_stats(history_before(history, origin), origin, [days], calendar, entity)
    return roll_up(stats, [*entity, *keys], days, profile, SUPPORTS.get(profile))


def feature_frame(history: DataFrame, future: DataFrame, origin: date, calendar: Calendar = Calendar(),
                  scale: float = 1.0) -> DataFrame:
    """Target rows with every profile; missing statistics read as zero, like the model input.

    ``scale`` shrinks the windows for short histories.
    """
    windows = {name: (keys, max(1, int(w * scale)) if w else 0) for name, (keys, w) in PROFILES.items()}
    past = history_before(history, origin)
    stats = profile_stats(past, origin, sorted({w for _, w in windows.values()}), calendar)
    out = lead_columns(with_calendar(future, calendar), origin)
    for name, (keys, w) in windows.items():
        out = out.join(roll_up(stats, ["route", *keys], w, name, SUPPORTS.get(name)), ["route", *keys], "left")
    first = past.agg(F.datediff(F.lit(origin), F.min("date")).alias("history_days"))
    filled = [*PROFILES, *SUPPORTS.values()]
    return out.join(first, how="cross").select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in filled else F.col(c) for c in out.columns], "history_days")


def lead_columns(df: DataFrame, origin: Column | date) -> DataFrame:
    at = F.lit(origin) if isinstance(origin, date) else origin
    return df.select("*", (F.datediff("date", at) + 1).alias("lead_day"),
                     (F.weekday("date") >= 5).cast("int").alias("is_weekend"))


def training_origins(first: date, last: date, horizon: int, stride: int = 14, warmup: int = 56) -> list[date]:
    """Origins every ``stride`` days whose whole horizon is labelled."""
    earliest, latest = first + timedelta(days=warmup), last - timedelta(days=horizon - 1)
    if earliest > latest:
        raise ValueError("insufficient history for complete training horizons")
    return [earliest + timedelta(days=i) for i in range(0, (latest - earliest).days + 1, stride)]


def training_frame(history: DataFrame, origins: Sequence[date], horizon: int,
                   calendar: Calendar = Calendar()) -> DataFrame:
    """Features and truth of simulated origins in one plan: statistics carry the origin as a key."""
    lits = F.array(*[F.lit(o) for o in origins])
    past = history.withColumn("origin", F.explode(F.filter(lits, lambda o: F.col("date") < o)))
    windows = sorted({w for _, w in PROFILES.values()})
    stats = profile_stats(past, F.col("origin"), windows, calendar, extra=["origin"])
    ahead = history.withColumn("origin", F.explode(F.filter(
        lits, lambda o: (F.col("date") >= o) & (F.col("date") < F.date_add(o, horizon)))))
    out = lead_columns(with_calendar(ahead, calendar), F.col("origin"))
    for name, (keys, w) in PROFILES.items():
        out = out.join(roll_up(stats, ["origin", "route", *keys], w, name, SUPPORTS.get(name)),
                       ["origin", "route", *keys], "left")
    return out.fillna(0, [*PROFILES, *SUPPORTS.values()])


def median_profile(df: DataFrame, keys: Sequence[str], value: str = "boardings", name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def trend_ratio(history: DataFrame, origin: date, window: int, calendar: Calendar = Calendar(),
                floor: float = 0.75, ceiling: float = 1.25) -> DataFrame:
    """Recent over previous mean level per route and day type, clipped; 1 when undefined."""
    past = with_calendar(history_before(history, origin), calendar)
    now = recent(origin, window)
    before = ~now & (F.col("date") >= F.lit(origin - timedelta(days=window * 3)))
    levels = past.groupBy("route", "day_type").agg(
        F.avg(F.when(now, F.col("boardings"))).alias("a"), F.avg(F.when(before, F.col("boardings"))).alias("b"))
    ratio = F.coalesce(F.try_divide("a", "b"), F.lit(1.0))
    return levels.where("a IS NOT NULL").select(
        "route", "day_type", F.least(F.greatest(ratio, F.lit(floor)), F.lit(ceiling)).alias("ratio"))


def hour_shares(df: DataFrame, group: Sequence[str], value: str = "boardings", name: str = "share") -> DataFrame:
    """Share of each hour in its group total (NULL for a group without mass)."""
    hourly = df.groupBy(*group, "hour").agg(F.sum(value).alias("_h"))
    totals = hourly.groupBy(*group).agg(F.sum("_h").alias("_t"))
    return hourly.join(totals, list(group)).select(*group, "hour", F.try_divide("_h", "_t").alias(name))


def weekly_profiles(history: DataFrame, origin: date, calendar: Calendar = Calendar(), scale: float = 1.0) -> DataFrame:
    """Per route, weekday and hour: 1/2/4/8-week means, 4-week median, ratios to four weeks, levels."""
    weeks = {w: max(1, round(7 * w * scale)) for w in (1, 2, 4, 8)}
    past = with_calendar(history_before(history, origin), calendar)
    keys = ["route", "dow", "hour"]
    means = past.groupBy(*keys).agg(*[
        F.avg(F.when(recent(origin, d), F.col("boardings"))).alias(f"week{w}") for w, d in weeks.items()])
    four = past.where(recent(origin, weeks[4]))
    median = median_profile(four, keys, name="median4")
    level_days = {7: max(1, round(7 * scale)), 28: max(1, round(28 * scale))}
    daily = past.groupBy("route", "date").agg(F.sum("boardings").alias("total"))
    levels = daily.groupBy("route").agg(*[
        F.avg(F.when(recent(origin, d), F.col("total"))).alias(f"routelevel{n}") for n, d in level_days.items()])
    scaled = F.greatest("week4", F.lit(20.0))
    return means.join(median, keys, "left").join(levels, "route", "left").select(
        "*", *[(F.col(f"week{w}") / scaled).alias(f"ratio{w}") for w in (1, 2, 8)])


def profile_reduce(history: DataFrame, origin: date, keys: Sequence[str], statistic: str, window: int = 0,
                   half_life: float = 28.0, name: str = "level") -> DataFrame:
    """One reducer of the sweep: mean, exp, median, q40, q60, trim10, month_equal, month_exp."""
    past = history_before(history, origin).where(recent(origin, window))
    age = F.datediff(F.lit(origin), F.col("date"))
    month_age = ((F.lit(origin.year) - F.year("date")) * 12 + F.lit(origin.month) - F.month("date"))
    value = F.col("boardings")
    if statistic == "mean":
        return past.groupBy(*keys).agg(F.avg(value).alias(name))
    if statistic == "exp":
        weight = F.pow(F.lit(2.0), -age / half_life)
        return past.groupBy(*keys).agg((F.sum(weight * value) / F.sum(weight)).alias(name))
    if statistic in ("median", "q40", "q60"):
        return exact_quantiles(past, keys, "boardings", {name: {"median": 0.5, "q40": 0.4, "q60": 0.6}[statistic]})
    if statistic == "trim10":
        return trimmed_mean(past, keys, "boardings", 0.1, name)
    if statistic in ("month_equal", "month_exp"):
        monthly = past.where(month_age > 0).groupBy(*keys, month_age.alias("_age")).agg(F.avg(value).alias("_m"))
        weight = F.lit(1.0) if statistic == "month_equal" else F.pow(F.lit(2.0), -F.col("_age") / half_life)
        return monthly.groupBy(*keys).agg((F.sum(weight * F.col("_m")) / F.sum(weight)).alias(name))
    raise ValueError(f"unknown statistic {statistic!r}")


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Mean without the lowest and highest ``floor(share * n)`` rows, from value frequencies."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_c").over(w)
    cut = F.floor(total * share)
    kept = F.greatest(F.least(F.col("_upto"), F.col("_n") - F.col("_cut"))
                      - F.greatest(F.col("_upto") - F.col("_c"), F.col("_cut")), F.lit(0))
    ranked = counted.select("*", upto.alias("_upto"), total.alias("_n"), cut.alias("_cut")).withColumn("_k", kept)
    return ranked.groupBy(*keys).agg((F.sum(F.col("_k") * F.col(value)) / F.sum("_k")).alias(name))


def smooth_level(daily: DataFrame, alpha: float, damping: float | None = None, trend_rate: float = 0.05) -> DataFrame:
    """Exponential (or damped-trend) level per route over ordered days.

    The fold runs over one array of daily totals per route: its length is the number of days.
    """
    ordered = daily.groupBy("route").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", F.col("total").cast("double").alias("total")))),
                    lambda s: s["total"]).alias("series"))
    start = F.struct(F.get("series", F.lit(0)).alias("level"), F.lit(0.0).alias("trend"))
    rest = F.expr("slice(series, 2, greatest(size(series) - 1, 0))")
    if damping is None:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((F.lit(alpha) * x + F.lit(1 - alpha) * acc["level"]).alias("level"),
                            F.lit(0.0).alias("trend"))
    else:
        def step(acc: Column, x: Column) -> Column:
            level = F.lit(alpha) * x + F.lit(1 - alpha) * (acc["level"] + F.lit(damping) * acc["trend"])
            trend = F.lit(trend_rate) * (level - acc["level"]) + F.lit((1 - trend_rate) * damping) * acc["trend"]
            return F.struct(level.alias("level"), trend.alias("trend"))
    folded = F.aggregate(rest, start, step)
    return ordered.select("route", folded.alias("f")).select(
        "route", F.col("f.level").alias("level"), F.col("f.trend").alias("trend"))
