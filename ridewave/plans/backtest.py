"""Folds, rolling-origin backtests and candidate comparison."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridewave.operators.evaluate import error_metrics, pool, score_slices


class FoldModel(Protocol):
    """A model sees history before the fold origin and the future keys, and answers ``prediction``."""

    name: str
    version: str

    def predict(self, history: DataFrame, future: DataFrame, origin: date) -> DataFrame: ...


def build_folds(coverage: DataFrame, required_train: int, embargo: int = 0, min_ratio: float = 1.0,
                validation_months: int = 1) -> DataFrame:
    """Month-horizon folds graded once: accepted, or refused with the first failing rule.

    Works on the coverage calendar (one row per civil date), never on the labels.
    """
    c = F.col
    span = coverage.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    calendar = span.select(F.explode(F.sequence("first", "last")).alias("date")).join(
        coverage.select("date", F.lit(1).alias("covered")), "date", "left").withColumn(
        "covered", F.coalesce("covered", F.lit(0)))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prefix = calendar.withColumn("before", F.coalesce(F.sum("covered").over(w), F.lit(0)))
    edge = prefix.agg(F.date_add(F.max("date"), 1).alias("date"), F.sum("covered").alias("before"))
    marks = prefix.select("date", "before").unionByName(edge)
    opening = F.when(F.dayofmonth("first") == 1, c("first")).otherwise(F.add_months(F.trunc("first", "month"), 1))
    origins = span.select("first", F.date_add("last", 1).alias("limit"), F.explode(F.sequence(
        opening, F.col("last"), F.expr("interval 1 month"))).alias("origin"))
    folds = origins.select(
        "*", F.add_months("origin", 1).alias("test_end"),
        F.add_months("origin", -validation_months).alias("validation_start")).withColumn(
        "train_end", F.date_sub("validation_start", embargo))

    def covered_to(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(marks.select(F.col("date").alias(column), F.col("before").alias(name)), column, "left")

    graded = covered_to(covered_to(covered_to(folds, "origin", "_o"), "test_end", "_t"), "train_end", "_v")
    labels, days = c("_t") - c("_o"), F.datediff("test_end", "origin")
    train_days = F.greatest(F.datediff("train_end", "first"), F.lit(0))
    train_covered = F.coalesce("_v", F.lit(0))
    reason = (F.when(c("test_end") > c("limit"), "horizon_beyond_data")
              .when(labels < days, "incomplete_labels").when(labels / days < min_ratio, "diluted_labels")
              .when((c("validation_start") < c("first")) | (train_days < required_train)
                    | (train_covered < required_train), "insufficient_train_history"))
    return graded.select(
        F.concat(F.lit("month@"), c("origin").cast("string")).alias("fold_id"), "origin", "validation_start", "train_end",
        "test_end", train_days.alias("train_buckets"), train_covered.cast("bigint").alias("train_covered_buckets"),
        reason.alias("refusal"))


def fold_targets(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Label rows of each fold's test window; truth is attached last and never feeds features."""
    usable = folds.where("refusal IS NULL").select("fold_id", "origin", "test_end", F.trunc("origin", "month").alias("_m"))
    return labels.withColumn("_m", F.trunc("date", "month")).join(usable, "_m").where(
        "date >= origin AND date < test_end").drop("_m", "test_end")


def backtest(scored: DataFrame, folds: DataFrame, minimum_origins: int, with_demand: int) -> DataFrame:
    """Per model: pooled metrics, eligible origins, origins with demand and the verdict."""
    per_fold = error_metrics(scored, ["model", "fold_id"])
    totals = pool(per_fold, ["model"])
    demand = per_fold.groupBy("model").agg(F.count_if(F.col("actual_total") > 0).alias("origins_with_demand"))
    eligible = folds.agg(F.count_if(F.col("refusal").isNull()).alias("eligible_origins"))
    status = (F.when(F.col("eligible_origins") < minimum_origins, "insufficient_history")
              .when(F.col("origins_with_demand") < with_demand, "insufficient_signal").otherwise("evaluated"))
    return totals.join(demand, "model").join(eligible, how="cross").withColumn("status", status)


def run_models(history: DataFrame, models: Sequence[FoldModel], origins: Sequence[date], horizon: int) -> DataFrame:
    """Predictions of every model at every origin with truth attached after prediction."""
    if len({m.name for m in models}) != len(models):
        raise ValueError("model names must be unique within one backtest")
    parts = []
    for origin in origins:
        past = history.where(F.col("date") < F.lit(origin))
        ahead = history.where((F.col("date") >= F.lit(origin)) & (F.col("date") < F.date_add(F.lit(origin), horizon)))
        future = ahead.select("route", "date", "hour")
        for model in models:
            answer = model.predict(past, future, origin).select("route", "date", "hour", "prediction")
            parts.append(ahead.join(answer, ["route", "date", "hour"]).select(
                F.lit(model.name).alias("model"), F.lit(origin).alias("origin"), "route", "date", "hour", "boardings",
                "prediction", (F.datediff("date", F.lit(origin)) + 1).alias("lead_day")))
    return reduce(DataFrame.unionByName, parts)


def compare_models(predictions: DataFrame) -> DataFrame:
    """Scores of each model and origin: overall and by slice."""
    return score_slices(predictions, ["model", "origin"])
