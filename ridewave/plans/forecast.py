"""Closed-form forecasts, blends, sweeps and the switch guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.functions.metrics import clip, half_life, rounded
from ridewave.operators.evaluate import rank_models, score
from ridewave.operators.joins import require
from ridewave.operators.profiles import (
    Calendar, assert_before, feature_frame, history_before, hour_shares, median_profile, recent, trend_ratio, trimmed_mean, with_calendar)

c = F.col
KEYS = ["route", "date", "hour"]


def profile_forecast() -> Column:
    """Seasonal weekday-hour mean where it has support, else the all-season one."""
    value = F.when(c("same_season_support") > 0, c("route_dow_hour_same_season")).otherwise(c("route_dow_hour_all"))
    return F.greatest(F.lit(0.0), value)


def calendar_profile() -> Column:
    """Day-type mean on exceptional dates that have support."""
    special = (c("exception") > 0) & (c("day_type_support") > 0)
    return F.greatest(F.lit(0.0), F.when(special, c("route_day_type_hour_same_season")).otherwise(profile_forecast()))


def weekday_blend() -> Column:
    """Equal mix of weekday and day-type means on ordinary dates."""
    ordinary = (c("exception") == 0) & (c("day_type_support") > 0)
    mix = calendar_profile() * 0.5 + c("route_day_type_hour_same_season") * 0.5
    return F.greatest(F.lit(0.0), F.when(ordinary, mix).otherwise(calendar_profile()))


@dataclass(frozen=True)
class Robust:
    window: int
    strength: float
    half_life: float
    median_weight: float


# The two robust profiles and the hour-shape correction.
ROBUST = {"short": Robust(14, 0.3, 42, 0.25), "long": Robust(28, 0.3, 84, 0.5)}
SHAPE_RECENT, SHAPE_PREVIOUS, SHAPE_FLOOR, SHAPE_CEILING, SHAPE_STRENGTH = 28, 56, 0.75, 1.25, 0.2


def robust_profile(history: DataFrame, features: DataFrame, origin: date, variant: str,
                   calendar: Calendar = Calendar(), scale: float = 1.0) -> DataFrame:
    """Blend profile with a decaying trend and a pull to the median; ``blend`` averages both variants."""
    if variant == "blend":
        a = robust_profile(history, features, origin, "short", calendar, scale)
        b = robust_profile(history, features, origin, "long", calendar, scale)
        return a.withColumnRenamed("prediction", "_a").join(
            b.select(*KEYS, c("prediction").alias("_b")), KEYS).withColumn(
            "prediction", c("_a") * 0.5 + c("_b") * 0.5).drop("_a", "_b")
    config = ROBUST[variant]
    past = with_calendar(assert_before(history, origin), calendar)
    by_weekday = median_profile(past, ["route", "season", "dow", "hour"], name="_mw")
    by_type = median_profile(past, ["route", "season", "day_type", "hour"], name="_mt")
    ratio = trend_ratio(history, origin, max(1, int(config.window * scale)), calendar)
    rows = (features.withColumn("_base", weekday_blend())
            .join(by_weekday, ["route", "season", "dow", "hour"], "left")
            .join(by_type, ["route", "season", "day_type", "hour"], "left")
            .join(ratio, ["route", "day_type"], "left"))
    middle = F.when(c("exception") > 0, c("_mt")).otherwise(c("_mw") * 0.5 + c("_mt") * 0.5)
    median = F.coalesce(middle, c("_base"))
    decay = half_life(c("lead_day") - 1, config.half_life)
    trend = F.lit(1.0) + F.lit(config.strength) * decay * (F.coalesce("ratio", F.lit(1.0)) - 1)
    value = c("_base") * trend + F.lit(config.median_weight) * (median - c("_base"))
    return rows.withColumn("prediction", F.greatest(F.lit(0.0), value)).select(*features.columns, "prediction")


def rescale_to_day(df: DataFrame, adjusted: str, base: str, name: str = "prediction") -> DataFrame:
    """Give adjusted hours the day total of the base (a route-day is 24 rows)."""
    day = Window.partitionBy("route", "date")
    total, wanted = F.sum(adjusted).over(day), F.sum(base).over(day)
    return df.withColumn(name, F.when(total > 0, c(adjusted) * wanted / total).otherwise(c(base)))


def hour_shape(history: DataFrame, base: DataFrame, origin: date, group: Sequence[str],
               calendar: Calendar = Calendar(), scale: float = 1.0) -> DataFrame:
    """Move hours toward recent shares while every route-day total stays as it is."""
    a, b = max(1, int(SHAPE_RECENT * scale)), max(1, int(SHAPE_PREVIOUS * scale))
    past = with_calendar(assert_before(history, origin), calendar)
    new = hour_shares(past.where(recent(origin, a)), group, name="_new")
    old = hour_shares(past.where(~recent(origin, a) & recent(origin, a + b)), group, name="_old")
    ratio = new.join(old, [*group, "hour"]).select(
        *group, "hour", clip(F.try_divide("_new", "_old"), SHAPE_FLOOR, SHAPE_CEILING).alias("_ratio"))
    defined = ratio.where("_ratio IS NOT NULL")
    rows = base.withColumnRenamed("prediction", "_base").join(defined, [*group, "hour"], "left")
    shifted = c("_base") * (F.lit(1.0) + F.lit(SHAPE_STRENGTH) * (F.coalesce("_ratio", F.lit(1.0)) - 1))
    out = rescale_to_day(rows.withColumn("_shifted", shifted), "_shifted", "_base")
    return out.select(*[x for x in base.columns if x != "prediction"], "prediction")


def blend(frames: Mapping[str, DataFrame], weights: Mapping[str, float], base: str) -> DataFrame:
    """Base plus weighted branches; the weights stay on the simplex and the grids must agree."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-12:
        raise ValueError("blend weights must be nonnegative and sum to at most one")
    out = frames[base].select(*KEYS, c("prediction").alias("_base"))
    for name in weights:
        out = out.join(frames[name].select(*KEYS, c("prediction").alias("_" + name)), KEYS, "full")
    out = require(out, F.greatest(c("_base").isNull(), *[c("_" + n).isNull() for n in weights]),
                  "blend branches must share one grid")
    value = c("_base") * (1 - sum(weights.values()))
    for name, w in weights.items():
        value = value + c("_" + name) * w
    return out.select(*KEYS, value.alias("prediction"))


def weight_grid(branches: Sequence[str], steps: Sequence[float], limit: float = 0.30) -> list[tuple[float, ...]]:
    """Weight combinations of the search: a parameter grid, not data."""
    return [w for w in product(steps, repeat=len(branches)) if sum(w) <= limit + 1e-12]


def choose_weights(calibration: DataFrame, branches: Sequence[str], steps: Sequence[float] = (0.0, 0.05, 0.1, 0.15),
                   limit: float = 0.30) -> DataFrame:
    """Best grid point by score; ties go to fewer, then smaller weights.

    Every combination is an aggregate of the same scan, so the data is read once.
    """
    grid = weight_grid(branches, steps, limit)
    sums = []
    for i, combo in enumerate(grid):
        value = c("base") * (1 - sum(combo))
        for name, w in zip(branches, combo, strict=True):
            value = value + c(name) * w
        sums.append(F.sum(F.abs(c("boardings") - rounded(value))).alias(f"e{i}"))
    totals = calibration.agg(F.sum(c("boardings").cast("double")).alias("a"), *sums)
    rows = F.array(*[F.struct(
        *[F.lit(float(w)).alias(n) for n, w in zip(branches, combo, strict=True)],
        F.lit(sum(w > 0 for w in combo)).alias("used"), F.lit(float(round(sum(combo), 6))).alias("mass"),
        F.round(F.lit(1.0) - F.try_divide(f"e{i}", "a"), 12).alias("score")) for i, combo in enumerate(grid)])
    order = F.struct(c("score"), -c("used"), -c("mass"), *[-c(n) for n in branches])
    flat = totals.select(F.explode(rows).alias("r")).select("r.*")
    return flat.agg(F.max_by(F.struct(*flat.columns), order).alias("best")).select("best.*")


def accept_weights(folds: DataFrame, minimum_gain: float, segment_loss: float) -> DataFrame:
    """Gain per window and bounded loss per segment; ``folds`` holds before and after predictions."""
    band = F.lpad((F.floor(c("hour") / 6) * 6).cast("string"), 2, "0")
    axes = F.array(F.struct(F.lit("overall").alias("axis"), F.lit("").alias("member")),
                   F.struct(F.lit("route").alias("axis"), c("route").cast("string").alias("member")),
                   F.struct(F.lit("hours").alias("axis"), band.alias("member")))
    error = lambda p: F.sum(F.abs(c("boardings") - rounded(c(p))))
    g = folds.withColumn("_k", F.explode(axes)).groupBy("origin", "_k.axis", "_k.member").agg(
        F.sum(c("boardings").cast("double")).alias("a"), error("before").alias("eb"), error("after").alias("ea"))
    zero = F.lit(0.0)
    change = F.greatest(zero, 1 - F.try_divide("ea", "a")) - F.greatest(zero, 1 - F.try_divide("eb", "a"))
    scored = g.where("a > 0").withColumn("change", change)
    return scored.groupBy("origin").agg(
        F.max(F.when(c("axis") == "overall", c("change"))).alias("gain"),
        F.min(F.when(c("axis") != "overall", c("change"))).alias("worst_segment")).withColumn(
        "accepted", (c("gain") >= minimum_gain) & (c("worst_segment") >= -segment_loss))


@dataclass(frozen=True)
class Config:
    """One statistical configuration of the sweep."""

    name: str
    statistic: str = "mean"
    window: int = 0
    half_life: float = 28.0
    seasonal: bool = False
    day_type_weight: float = 0.0
    correction: float = 0.0
    months: int = 0


QUANTILES = {"median": 0.5, "q40": 0.4, "q60": 0.6}


def _rule(k: Config) -> tuple[str, int, int, float]:
    """What the level of a configuration depends on: configurations of one rule share its column."""
    return k.statistic, k.window, k.months, float(k.half_life) if k.statistic in ("exp", "month_exp") else 0.0


def _levels(rows: DataFrame, rules: Sequence[tuple[str, int, int, float]]) -> DataFrame:
    """The cells of ``rows`` (origin, route, hour, k, v, age, month_age) with a column ``l<i>`` per rule.

    All means and quantiles are conditional columns of one aggregate; quantiles hold value frequencies.  Monthly rules share
    one further aggregate by month, trimmed ones take value frequencies once for each reach.
    """
    cell = ["origin", "route", "hour", "k"]

    def seen(rule) -> Column:
        statistic, window, months, _ = rule
        ok = c("age") > 0
        if window:
            ok = ok & (c("age") <= window)
        if months or statistic.startswith("month_"):
            ok = ok & (c("month_age") > 0)
        return ok & (c("month_age") <= months) if months else ok

    plain, monthly, trimmed = [], [], []
    for i, rule in enumerate(rules):
        statistic, v = rule[0], F.when(seen(rule), c("v"))
        if statistic == "trim10":
            trimmed.append((i, rule))
        elif statistic.startswith("month_"):
            monthly.append((i, rule))
        elif statistic in QUANTILES:
            plain.append(F.percentile(v, F.lit(QUANTILES[statistic])).alias(f"l{i}"))
        elif statistic == "exp":
            weight = F.pow(F.lit(2.0), -c("age") / rule[3])
            plain.append((F.sum(weight * v) / F.sum(F.when(v.isNotNull(), weight))).alias(f"l{i}"))
        else:
            plain.append(F.avg(v).alias(f"l{i}"))
    out = rows.groupBy(*cell).agg(*(plain or [F.count(F.lit(1)).alias("_n")])).drop("_n")
    if monthly:
        means = rows.groupBy(*cell, "month_age").agg(*[F.avg(F.when(seen(rule), c("v"))).alias(f"m{i}") for i, rule in monthly])
        weights = {i: F.pow(F.lit(2.0), -c("month_age") / rule[3]) if rule[3] else F.lit(1.0) for i, rule in monthly}
        out = out.join(means.groupBy(*cell).agg(*[(F.sum(weights[i] * c(f"m{i}")) / F.sum(F.when(c(f"m{i}").isNotNull(), weights[i]))).alias(f"l{i}") for i, _ in monthly]), cell)
    for i, rule in trimmed:
        out = out.join(trimmed_mean(rows.where(seen(rule) & c("v").isNotNull()), cell, "v", 0.1, f"l{i}"), cell, "left")
    return out


def sweep(labels: DataFrame, origins: Sequence[date], configs: Sequence[Config], horizon: int,
          calendar: Calendar = Calendar()) -> DataFrame:
    """Predictions of every configuration at every origin, with truth, as one plan.

    Label rows go to the origins that may see them, once per axis (weekday, day type, and both by season where a
    configuration asks for it).  Configurations are columns of the cells, so scans, joins and shuffled rows do not
    grow with them; they become rows only beside the target days.
    """
    rules = list(dict.fromkeys(_rule(k) for k in configs))
    seasonal = any(k.seasonal for k in configs)
    wanted = F.array(*[F.lit(o) for o in origins])
    age, month_age = F.datediff("origin", "date"), (F.year("origin") - F.year("date")) * 12 + F.month("origin") - F.month("date")
    part = [F.lit(-1), c("season")] if seasonal else [F.lit(-1)]
    axes = F.array(*[F.struct(F.lit(name).alias("axis"), c(member).alias("member"), s.alias("part"))
                     for name, member in (("dow", "dow"), ("type", "day_type")) for s in part])
    rows = with_calendar(labels, calendar).withColumn("origin", F.explode(F.filter(wanted, lambda o: c("date") < o))).select(
        "origin", "route", "hour", F.explode(axes).alias("k"), c("boardings").cast("double").alias("v"), age.alias("age"), month_age.alias("month_age"))
    levels = _levels(rows, rules).select("origin", "route", "hour", "k.*", F.array(*[c(f"l{i}") for i in range(len(rules))]).alias("_l"))
    target = with_calendar(labels, calendar).withColumn("origin", F.explode(F.filter(
        wanted, lambda o: (c("date") >= o) & (c("date") < F.date_add(o, horizon)))))
    for axis, member in (("dow", "dow"), ("type", "day_type")):
        mine = levels.where(c("axis") == axis).drop("axis").withColumnRenamed("member", member)
        target = target.join(mine.where("part < 0").drop("part").withColumnRenamed("_l", f"_{axis}"), ["origin", "route", "hour", member], "left")
        if seasonal:
            target = target.join(mine.where("part >= 0").select("origin", "route", "hour", member, c("part").alias("season"), c("_l").alias(f"_{axis}_season")),
                                 ["origin", "route", "hour", member, "season"], "left")

    def level(axis: str, k: Config) -> Column:
        at = F.lit(rules.index(_rule(k)))
        return F.coalesce(F.get(f"_{axis}_season", at), F.get(f"_{axis}", at)) if k.seasonal else F.get(f"_{axis}", at)

    named = F.array(*[F.struct(F.lit(k.name).alias("model"), F.lit(float(k.day_type_weight)).alias("weight"), F.lit(float(k.correction)).alias("correction"),
                               level("dow", k).alias("dow"), level("type", k).alias("kind")) for k in configs])
    target = target.withColumn("m", F.explode(named))
    w = F.when(c("exception") > 0, F.lit(1.0)).otherwise(c("m.weight"))
    mixed = F.when(w == 0, c("m.dow")).when(w == 1, c("m.kind")).otherwise((1 - w) * c("m.dow") + w * c("m.kind"))
    past = labels.withColumn("origin", F.explode(F.filter(wanted, lambda o: (c("date") < o) & (c("date") >= F.date_sub(o, 42)))))
    ages = F.datediff("origin", "date")
    ratios = past.groupBy("origin", "route").agg(
        F.avg(F.when(ages <= 14, c("boardings"))).alias("_a"), F.avg(F.when(ages > 14, c("boardings"))).alias("_b"))
    ratio = clip(F.coalesce(F.when(c("_b") > 0, c("_a") / c("_b")), F.lit(1.0)), 0.8, 1.2)
    factor = F.lit(1.0) + c("m.correction") * (ratio - 1)
    return target.join(ratios, ["origin", "route"], "left").select(
        c("m.model").alias("model"), "origin", "route", "date", "hour", "boardings", F.greatest(F.lit(0.0), mixed * factor).alias("prediction"))


def window_means(labels: DataFrame, origins: Sequence[date], windows: Sequence[int], horizon: int, factor: float = 1.0) -> DataFrame:
    """Mean of the last days per route and hour for many origins and windows in one plan."""
    wanted = F.array(*[F.lit(o) for o in origins])
    past = labels.withColumn("origin", F.explode(F.filter(wanted, lambda o: (c("date") < o) & (c("date") >= F.date_sub(o, max(windows))))))
    age = F.datediff("origin", "date")
    levels = past.groupBy("origin", "route", "hour").agg(*[F.avg(F.when(age <= w, c("boardings"))).alias(f"m{w}") for w in windows])
    ahead = labels.withColumn("origin", F.explode(F.filter(wanted, lambda o: (c("date") >= o) & (c("date") < F.date_add(o, horizon)))))
    models = F.explode(F.array(*[F.struct(F.lit(f"mean_{w}").alias("model"), (c(f"m{w}") * factor).alias("prediction")) for w in windows]))
    return ahead.join(levels, ["origin", "route", "hour"]).select("origin", "route", "date", "hour", "boardings", models.alias("m")).select(
        "m.model", "origin", "route", "date", "hour", "boardings", "m.prediction")


def sweep_ranking(predictions: DataFrame) -> DataFrame:
    return rank_models(score(predictions, ["model", "origin"]))


def stop_profile(history: DataFrame, origin: date, window: int, keys: Sequence[str] = ("stop_id", "direction", "dow", "hour"),
                 value: str = "expected", name: str = "level") -> DataFrame:
    """Mean of unmasked cells in the window; a masked (NULL) cell is ignored, not zero."""
    past = history_before(history, origin).where(recent(origin, window)).withColumn("dow", F.weekday("date"))
    return past.groupBy(*keys).agg(F.avg(value).alias(name), F.count(value).alias("support"))


def scenario_mix(base: DataFrame, branches: DataFrame, factors: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Scenario = branches mixed by normalised factors; the ratio to base scales every stop cell."""
    total = sum(factors.values())
    if total <= 0 or any(v < 0 for v in factors.values()):
        raise ValueError("scenario factors must be nonnegative with a positive sum")
    mixed = reduce(lambda a, b: a + b, [c(n) * (v / total) for n, v in factors.items()])
    ratio = branches.select(*keys, F.coalesce(F.try_divide(mixed, c("base")), F.lit(1.0)).alias("ratio"))
    return base.join(ratio, list(keys), "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0))).withColumn(
        "scenario", c("baseline") * c("ratio"))


def review_switch(scores: DataFrame, signals: DataFrame, origin: date, incumbent: str, horizon: int = 61,
                  min_origins: int = 2, min_gain: float = 0.002) -> DataFrame:
    """Switch only on gains at earlier disjoint origins that showed the same shift.

    ``scores`` has (model, origin, route, score) with route NULL for the overall score, at
    origins spaced by whole horizons before ``origin``; ``signals`` the shifts at all origins.
    """
    now = signals.where(c("origin") == F.lit(origin)).select("kind", "route", "direction")
    prior = signals.where(c("origin") <= F.lit(origin - timedelta(days=horizon))).join(
        now, ["kind", "route", "direction"], "left_semi").select("origin", "route").distinct()
    matched = prior.select("origin").distinct().withColumn("matching", F.lit(True))
    overall = scores.where("route IS NULL").join(matched, "origin", "left")
    base = overall.where(c("model") == incumbent).select("origin", c("score").alias("_b"))
    gains = overall.where(c("model") != incumbent).join(base, "origin").withColumn("gain", c("score") - c("_b"))
    per_route = scores.where("route IS NOT NULL").join(prior, ["origin", "route"], "left_semi")
    base_route = per_route.where(c("model") == incumbent).select("origin", "route", c("score").alias("_b"))
    entity = per_route.where(c("model") != incumbent).join(base_route, ["origin", "route"], "left").groupBy("model").agg(
        F.count_if(c("score").isNull() | c("_b").isNull()).alias("incomplete"), F.min(c("score") - c("_b")).alias("worst_entity_gain"))
    out = gains.groupBy("model").agg(
        F.min("gain").alias("worst_gain"), F.min(F.when(c("matching"), c("gain"))).alias("worst_matching_gain"),
        F.count_if("matching").alias("comparable_origins")).join(entity, "model", "left")
    eligible = ((c("comparable_origins") >= min_origins) & (c("worst_gain") >= 0) & (c("worst_matching_gain") >= min_gain)
                & (F.coalesce(c("incomplete"), F.lit(1)) == 0) & (c("worst_entity_gain") > 0))
    shifted = now.agg((F.count(F.lit(1)) > 0).alias("has_shift"))
    status = (F.when(~c("has_shift"), "no_shift").when(c("eligible"), "switch_supported")
              .when(c("comparable_origins") >= min_origins, "candidate_rejected").otherwise("insufficient_evidence"))
    return out.withColumn("eligible", F.coalesce(eligible, F.lit(False))).join(shifted, how="cross").withColumn("status", status)
