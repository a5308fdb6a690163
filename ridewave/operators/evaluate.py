"""Scores, slices, gates and checks of forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.functions.clock import daypart
from ridewave.functions.metrics import rounded, wape, winkler
from ridewave.operators.joins import require


def error_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Pooled sums and the ratios derived from them."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("scored"), F.sum(actual).alias("actual_total"),
                              F.sum(F.abs(F.col(actual) - F.col(predicted))).alias("error_total"))
    return with_ratios(out)


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumn("mae", F.try_divide("error_total", "scored")).withColumn(
        "wape", wape(F.col("error_total"), F.col("actual_total")))


def pool(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pool fold metrics by their sums; an average of averages would hide a slice."""
    return with_ratios(df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("scored", "actual_total", "error_total")]))


def score_columns(actual: str, predicted: str) -> dict[str, Column]:
    error = F.sum(F.abs(F.col(actual) - rounded(F.col(predicted))))
    total = F.sum(F.col(actual).cast("double"))
    return {"actual": total, "absolute_error": error,
            "score": F.when(total > 0, F.greatest(F.lit(0.0), F.lit(1.0) - wape(error, total)))}


def score(df: DataFrame, by: Sequence[str], actual: str = "boardings", predicted: str = "prediction") -> DataFrame:
    """1 - WAPE on rounded forecasts, never below zero; NULL without demand."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in score_columns(actual, predicted).items()])


def score_slices(df: DataFrame, extra: Sequence[str] = (), actual: str = "boardings",
                 predicted: str = "prediction") -> DataFrame:
    """Overall, by route, six-hour band, lead band and in peak hours, in one pass."""
    lead = F.col("lead_day")
    axes = F.array_compact(F.array(
        F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("member")),
        F.struct(F.lit("route").alias("dimension"), F.col("route").cast("string").alias("member")),
        F.struct(F.lit("hours").alias("dimension"),
                 F.lpad((F.floor(F.col("hour") / 6) * 6).cast("string"), 2, "0").alias("member")),
        F.when(lead == 1, F.struct(F.lit("lead").alias("dimension"), F.lit("day1").alias("member"))),
        F.struct(F.lit("lead").alias("dimension"),
                 F.when(lead <= 31, "days1_31").otherwise("days32_61").alias("member")),
        F.when(F.col("hour").isin(7, 8, 9, 16, 17, 18, 19),
               F.struct(F.lit("peak").alias("dimension"), F.lit("").alias("member")))))
    out = df.withColumn("_a", F.explode(axes)).groupBy(*extra, "_a.dimension", "_a.member")
    return out.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in score_columns(actual, predicted).items()])


def evaluate_cases(cases: DataFrame, minimum_coverage: float = 0.8) -> DataFrame:
    """Array cases to pooled WAPE, baseline WAPE and interval coverage per horizon and overall.

    ``passed`` is the verdict over all slices.  Cases without demand in a slice stop the run.
    """
    cells = cases.select("horizon", F.explode(F.arrays_zip(
        "actual", "prediction", "baseline_prediction", "lower_bound", "upper_bound")).alias("c"))
    a = F.col("c.actual")
    per = cells.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("observations"), F.sum(a).alias("_d"),
        F.sum(F.abs(a - F.col("c.prediction"))).alias("_e"),
        F.sum(F.abs(a - F.col("c.baseline_prediction"))).alias("_b"),
        F.count_if(a.between(F.col("c.lower_bound"), F.col("c.upper_bound"))).alias("_k"))
    sums = per.rollup("horizon").agg(*[F.sum(c).alias(c) for c in ("observations", "_d", "_e", "_b", "_k")])
    sums = require(sums, F.col("_d") == 0, "zero demand: WAPE is undefined")
    out = sums.select(F.coalesce("horizon", F.lit("overall")).alias("slice"), "observations",
                      (F.col("_e") / F.col("observations")).alias("mae"), (F.col("_e") / F.col("_d")).alias("wape"),
                      (F.col("_b") / F.col("_d")).alias("baseline_wape"),
                      (F.col("_k") / F.col("observations")).alias("interval_coverage"))
    fine = (F.col("wape") <= F.col("baseline_wape")) & (F.col("interval_coverage") >= minimum_coverage)
    # four rows at most: one per horizon and the overall one
    return out.withColumn("passed", F.min(fine).over(Window.partitionBy()))


@dataclass(frozen=True)
class Thresholds:
    """The provisional gate limits."""

    min_samples: int = 12
    min_folds: int = 2
    max_wape: float = 0.40
    max_wape_ratio: float = 1.0
    max_coverage_shortfall: float = 0.10
    max_score_to_mean: float = 2.0
    min_level: float = 0.8
    score_allowance: float = 8.0


def slice_axes() -> Column:
    """The overlapping axes of one point; NULL entries are dropped."""
    def axis(name: str, *parts: Column) -> Column:
        return F.struct(F.lit(name).alias("axis"), F.concat_ws("|", *[p.cast("string") for p in parts]).alias("value"))

    c = F.col
    peak = c("daypart")
    return F.array_compact(F.array(
        axis("overall", F.lit("all")), axis("horizon", c("horizon")), axis("fold", c("fold")),
        F.when(c("event").isNotNull(), axis("event", c("event"))),
        F.when(peak.isNotNull(), axis("daypart", peak)),
        axis("route", c("route")), axis("direction", c("route"), c("direction")), axis("stop", c("stop")),
        axis("entity", c("route"), c("direction"), c("stop")),
        F.when(peak.isNotNull(), axis("route_daypart", c("route"), peak)),
        F.when(peak.isNotNull(), axis("entity_daypart", c("route"), c("direction"), c("stop"), peak))))


def slice_metrics(points: DataFrame, load_target: str = "onboard_load") -> DataFrame:
    """Metrics of every slice of eleven overlapping axes.

    Points are first summed at the finest slice key and fold, so what is multiplied by the
    axes is that small table and not the points.  A part that not every point supports
    (baseline, interval, capacity) is NULL rather than partial.
    """
    c = F.col
    point = points.withColumn("daypart", F.when(c("hour").isNotNull(), daypart(c("hour"))))
    bounded = c("lower").isNotNull() & c("upper").isNotNull()
    loaded = c("capacity").isNotNull() & (c("target") == load_target)
    fine = point.groupBy("horizon", "fold", "route", "direction", "stop", "daypart", "event").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").alias("a"),
        F.sum(F.abs(c("actual") - c("predicted"))).alias("e"), F.count("baseline").alias("nb"),
        F.sum(F.abs(c("actual") - c("baseline"))).alias("be"),
        F.count(F.when(bounded, 1)).alias("ni"), F.min("level").alias("l0"), F.max("level").alias("l1"),
        F.min("method").alias("m0"), F.max("method").alias("m1"),
        F.count_if(bounded & c("actual").between(c("lower"), c("upper"))).alias("ic"),
        F.sum(F.when(bounded, c("upper") - c("lower"))).alias("iw"),
        F.sum(F.when(bounded, winkler(c("lower"), c("upper"), c("level"), c("actual")))).alias("iscore"),
        F.count_if(loaded).alias("nc"), F.count_if(loaded & (c("actual") > c("capacity"))).alias("oa"),
        F.count_if(loaded & (c("predicted") > c("capacity"))).alias("op"))
    out = fine.withColumn("_k", F.explode(slice_axes())).groupBy("_k.axis", "_k.value").agg(
        *[F.sum(x).alias(x) for x in ("n", "a", "e", "nb", "be", "ni", "ic", "iw", "iscore", "nc", "oa", "op")],
        F.count_distinct("fold").alias("folds"), F.min("l0").alias("l0"), F.max("l1").alias("l1"),
        F.min("m0").alias("m0"), F.max("m1").alias("m1"))
    whole_interval = (c("ni") == c("n")) & (c("l0") == c("l1")) & (c("m0") == c("m1"))
    return out.select(
        "axis", "value", c("n").alias("samples"), "folds", c("a").alias("actual_total"), c("e").alias("error_total"),
        (c("e") / c("n")).alias("mae"), wape(c("e"), c("a")).alias("wape"),
        F.when(c("nb") == c("n"), wape(c("be"), c("a"))).alias("baseline_wape"),
        F.when(whole_interval, c("l0")).alias("interval_level"),
        F.when(whole_interval, c("ic") / c("n")).alias("interval_coverage"),
        F.when(whole_interval, c("iw") / c("n")).alias("mean_width"),
        F.when(whole_interval, c("iscore") / c("n")).alias("mean_interval_score"),
        F.when(c("nc") == c("n"), c("oa")).alias("actual_overloaded"),
        F.when(c("nc") == c("n"), c("op")).alias("predicted_overloaded"))


def interval_quality(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coverage, width and score; refused with a reason unless all points share level and method."""
    c = F.col
    bounded = c("lower").isNotNull() & c("upper").isNotNull()
    g = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(bounded, 1)).alias("k"),
        F.count_distinct(F.when(bounded, c("level"))).alias("levels"),
        F.count_distinct(F.when(bounded, c("method"))).alias("methods"),
        F.count_if(bounded & c("actual").between(c("lower"), c("upper"))).alias("hit"),
        F.sum(F.when(bounded, c("upper") - c("lower"))).alias("w"),
        F.sum(F.when(bounded, winkler(c("lower"), c("upper"), c("level"), c("actual")))).alias("s"))
    reason = (F.when(c("k") == 0, "no point carries an interval").when(c("k") < c("n"), "only some points carry an interval")
              .when(c("levels") > 1, "points declare different levels").when(c("methods") > 1, "points declare different methods"))
    ok = reason.isNull()
    return g.select(*by, reason.alias("reason"), F.when(ok, c("hit") / c("n")).alias("coverage"),
                    F.when(ok, c("w") / c("n")).alias("mean_width"), F.when(ok, c("s") / c("n")).alias("mean_score"))


def overload_quality(points: DataFrame, by: Sequence[str], load_target: str = "onboard_load") -> DataFrame:
    """Points over capacity, only where the target is an occupancy and every capacity is known."""
    c = F.col
    g = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("target") != load_target).alias("other"),
        F.count("capacity").alias("known"), F.count_if(c("actual") > c("capacity")).alias("a"),
        F.count_if(c("predicted") > c("capacity")).alias("p"))
    reason = F.when(c("other") > 0, "target is not an occupancy").when(c("known") < c("n"), "capacity is unknown")
    ok = reason.isNull()
    return g.select(*by, reason.alias("reason"), F.when(ok, c("a")).alias("actual_overloaded"),
                    F.when(ok, c("p")).alias("predicted_overloaded"), c("n").alias("samples"))


def baseline_totals(points: DataFrame, by: Sequence[str]) -> DataFrame:
    c = F.col
    g = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("baseline").alias("k"),
                                F.sum("actual").alias("a"), F.sum(F.abs(c("actual") - c("baseline"))).alias("e"))
    reason = F.when(c("k") == 0, "no point carries a baseline").when(c("k") < c("n"), "only some points carry a baseline")
    return g.select(*by, reason.alias("reason"), F.when(reason.isNull(), wape(c("e"), c("a"))).alias("baseline_wape"))


def slice_status(metrics: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Support before signal: folds, then samples, then demand."""
    status = (F.when((F.col("folds") < limits.min_folds) & (F.col("axis") != "fold"), "insufficient_history")
              .when(F.col("samples") < limits.min_samples, "insufficient_samples")
              .when(F.col("wape").isNull(), "insufficient_signal").otherwise("evaluated"))
    return metrics.withColumn("status", status)


def gate_failures(metrics: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Breached thresholds of evaluated slices, one row per breach."""
    c = F.col
    judged = slice_status(metrics, limits).where("status = 'evaluated'")
    mean = c("actual_total") / c("samples")
    score_limit = F.greatest(mean * limits.max_score_to_mean, F.lit(limits.score_allowance))

    def breach(metric: str, observed: Column, limit: Column, bad: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), observed.alias("observed"), limit.alias("limit"), bad.alias("bad"))

    least = c("interval_level") - limits.max_coverage_shortfall
    baseline = c("baseline_wape") * limits.max_wape_ratio
    checks = F.array(
        breach("interval_level", c("interval_level"), F.lit(limits.min_level), c("interval_level") < limits.min_level),
        breach("interval_coverage", c("interval_coverage"), least,
               (c("interval_level") >= limits.min_level) & (c("interval_coverage") < least)),
        breach("mean_interval_score", c("mean_interval_score"), score_limit, c("mean_interval_score") > score_limit),
        breach("wape", c("wape"), F.lit(limits.max_wape), c("wape") > limits.max_wape),
        breach("wape_vs_baseline", c("wape"), baseline, c("wape") > baseline))
    return judged.select("axis", "value", F.explode(checks).alias("k")).where("k.bad").select(
        "axis", "value", "k.metric", "k.observed", "k.limit")


def gate(metrics: DataFrame, required: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Verdict: breached thresholds, required slices not proven, slices left ungated."""
    graded = slice_status(metrics, limits)
    failures = gate_failures(metrics, limits).agg(F.count(F.lit(1)).alias("failures"))
    proven = required.join(graded.select("axis", "value", "status"), ["axis", "value"], "left")
    unproven = proven.agg(F.count_if(F.coalesce(F.col("status"), F.lit("missing")) != "evaluated").alias("unproven"))
    rest = graded.where("status <> 'evaluated'")
    ungated = rest.agg(
        F.count(F.lit(1)).alias("ungated"), F.count_if(F.col("status") == "insufficient_samples").alias("below_samples"),
        F.count_if(F.col("status") == "insufficient_history").alias("below_folds"),
        F.count_if(F.col("status") == "insufficient_signal").alias("without_signal"), F.max("wape").alias("worst_wape"))
    out = failures.join(unproven, how="cross").join(ungated, how="cross")
    return out.withColumn("passed", (F.col("failures") == 0) & (F.col("unproven") == 0))


def rank_models(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Best worst-case first, then mean, then name."""
    out = scores.groupBy("model").agg(F.min("score").alias("worst"), F.avg("score").alias("mean"),
                                      F.max("score").alias("best"))
    # one row per model configuration
    w = Window.orderBy(F.desc("worst"), F.desc("mean"), "model")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rank_blends(predictions: DataFrame, weights: Sequence[float], base: str, other: str,
                actual: str = "boardings") -> DataFrame:
    """Pooled score of fixed convex blends of two prediction columns over all origins."""
    sums = []
    for i, w in enumerate(weights):
        mixed = rounded((1 - w) * F.col(base) + w * F.col(other))
        sums.append(F.sum(F.abs(F.col(actual) - mixed)).alias(f"e{i}"))
    totals = predictions.agg(F.sum(F.col(actual).cast("double")).alias("a"), *sums)
    rows = F.array(*[F.struct(F.lit(float(w)).alias("weight"), (F.lit(1.0) - F.try_divide(f"e{i}", "a")).alias("score"))
                     for i, w in enumerate(weights)])
    return totals.select(F.explode(rows).alias("r")).select("r.weight", "r.score")


def canonical(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order over unique keys; a repeated key stops the run."""
    values = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(v).alias(v) for v in values])
    return require(grouped, F.col("_n") > 1, "a bucket is scored once per fold").select(*df.columns).orderBy(*keys)


def validate_forecast(points: DataFrame, horizon: DataFrame, entity: Sequence[str], has_interval: bool) -> DataFrame:
    """Problems of a forecast artifact: repeated or misaligned buckets, incomplete horizons, bounds."""
    c = F.col
    # a horizon is bounded by its calendar; dealing points by bucket would put a day's points into one task
    keyed = points.join(F.broadcast(horizon.select("bucket", F.lit(True).alias("_known"))), "bucket", "left")
    both = c("lower").isNotNull() & c("upper").isNotNull()
    one = c("lower").isNotNull() != c("upper").isNotNull()
    per = keyed.groupBy(*entity, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(c("_known").isNull()).alias("off"), F.bool_or(one).alias("half"),
        F.bool_or(both & ~c("predicted").between(c("lower"), c("upper"))).alias("outside"),
        F.bool_or((both if not has_interval else ~both)).alias("meta"))
    total = horizon.agg(F.count_distinct("bucket").alias("expected"))
    out = per.groupBy(*entity).agg(
        F.count_if(c("n") > 1).alias("repeated"), F.count_if("off").alias("misaligned"), F.count_if("half").alias("half_bounds"),
        F.count_if("outside").alias("outside_bounds"), F.count_if("meta").alias("bounds_disagree"),
        F.count_if(~c("off")).alias("_covered"))
    return out.join(total, how="cross").withColumn("missing_buckets", c("expected") - c("_covered")).drop(
        "expected", "_covered")


def scored_run_complete(points: DataFrame, expected: DataFrame, routes: DataFrame, start, end) -> DataFrame:
    """Per run: every route has the expected count, no invalid row, buckets aligned to days."""
    c = F.col
    bad = c("_known").isNull() | (c("bucket") < F.lit(start)) | (c("bucket") >= F.lit(end))
    keyed = points.join(routes.select("route_id", F.lit(True).alias("_known")), "route_id", "left")
    per = keyed.groupBy("run_id", "route_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    need = routes.agg(F.count(F.lit(1)).alias("routes_expected"))
    out = per.join(expected, "run_id").groupBy("run_id").agg(
        F.sum("n").alias("points"), F.sum("bad").alias("invalid"),
        F.count_if(c("n") == c("per_route")).alias("complete_routes"))
    return out.join(need, how="cross").withColumn(
        "complete", (c("invalid") == 0) & (c("complete_routes") == c("routes_expected"))).drop("routes_expected")


def quality_gate(origins: DataFrame, by: Sequence[str], cutoff, horizon: int = 61, spacing: int = 45) -> DataFrame:
    """At least three spaced origins inside history, two gains and no loss."""
    # a report holds a handful of origins per candidate
    w = Window.partitionBy(*by).orderBy("origin")
    c = F.col
    spaced = origins.withColumn("_gap", F.datediff("origin", F.lag("origin").over(w)))
    out = spaced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("origins"), F.min("_gap").alias("closest"),
        F.bool_and(F.date_add("origin", horizon - 1) <= F.lit(cutoff)).alias("inside"),
        F.count_if(c("candidate_score") > c("baseline_score")).alias("gains"),
        F.count_if(c("candidate_score") < c("baseline_score")).alias("losses"))
    reason = (F.when(c("origins") < 3, "needs three origins")
              .when((c("closest") < spacing) | ~c("inside"), "origins must be separated history")
              .when((c("gains") < 2) | (c("losses") > 0), "gate failed on temporal slices"))
    return out.withColumn("reason", reason).withColumn("passed", reason.isNull())
