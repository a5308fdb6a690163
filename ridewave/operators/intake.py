"""Column profiles of an unknown delivery: no values leave the profile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def present(column: Column) -> Column:
    """Neither NULL nor blank."""
    return column.isNotNull() & (F.trim(column.cast("string")) != "")


def canonical(column: Column) -> Column:
    """One spelling per value: ``14.0`` and ``14`` are one identifier."""
    text = column.cast("string")
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def flag(column: Column) -> Column:
    word = F.lower(column.cast("string"))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def number(column: Column) -> Column:
    return column.cast("string").try_cast("double")


def signature(text: Column) -> Column:
    """Shape of an identifier: digits, letters, alnum, alnum_punct or other."""
    return (F.when(text.rlike(r"^\p{Nd}+$"), "digits").when(text.rlike(r"^\p{L}+$"), "letters")
            .when(text.rlike(r"^[\p{L}\p{N}]+$"), "alnum").when(text.rlike(r"^[\p{L}\p{N}_.:/-]+$"), "alnum_punct").otherwise("other"))


def _stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def profile_identifiers(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct values, null rate, lengths and shapes per column.

    Exact distinct counts go through one shuffle of (column, value hash) pairs; ``exact=False``
    uses a sketch for very wide deliveries.
    """
    value = canonical(c("value"))
    rows = _stacked(df, columns).withColumn("_t", F.when(present(c("value")), value))
    shape = signature(c("_t"))
    distinct = F.count_distinct("_t") if exact else F.approx_count_distinct("_t", 0.01)
    kinds = ("digits", "letters", "alnum", "alnum_punct", "other")
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_t").alias("present"), distinct.alias("distinct_values"),
        F.min(F.length("_t")).alias("min_length"), F.max(F.length("_t")).alias("max_length"),
        *[F.count_if(c("_t").isNotNull() & (shape == k)).alias(k) for k in kinds]).withColumn(
        "null_rate", 1 - c("present") / c("rows"))


def profile_timestamps(df: DataFrame, columns: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Unparsed texts, first, last and distinct dates per column."""
    value = c("value")
    at = value.try_cast("timestamp_ntz") if pattern is None else F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")
    rows = _stacked(df, columns).where(present(value)).withColumn("_at", at)
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("present"), F.count_if(c("_at").isNull()).alias("unparsed"), F.min("_at").alias("first"),
        F.max("_at").alias("last"), F.count_distinct(F.to_date("_at")).alias("dates"))


def profile_measures(df: DataFrame, contracts: Mapping[str, tuple[float, float, bool]]) -> DataFrame:
    """Range, sum and refusals per column; contract = (least, most, whole numbers only)."""
    rows = _stacked(df, list(contracts)).where(present(c("value"))).withColumn("_v", number(c("value")))
    least = F.create_map(*[F.lit(x) for k, (a, _, _) in contracts.items() for x in (k, float(a))])
    most = F.create_map(*[F.lit(x) for k, (_, b, _) in contracts.items() for x in (k, float(b))])
    whole = F.create_map(*[F.lit(x) for k, (_, _, w) in contracts.items() for x in (k, w)])
    integral = F.element_at(whole, c("column"))
    fits = c("_v").between(F.element_at(least, c("column")), F.element_at(most, c("column"))) & (~integral | (c("_v") == F.floor("_v")))
    g = rows.withColumn("_ok", fits).withColumn("_int", integral).groupBy("column").agg(
        F.count(F.lit(1)).alias("present"), F.count_if(c("_v").isNull()).alias("unparsed"),
        F.count_if(c("_v").isNotNull() & ~c("_ok")).alias("out_of_contract"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum"),
        F.sum(F.when(c("_ok") & c("_int"), c("_v").cast("decimal(38,0)"))).alias("_s"), F.bool_and("_int").alias("_int"))
    clean = c("_int") & (c("unparsed") == 0) & (c("out_of_contract") == 0)
    return g.withColumn("sum", F.when(clean, c("_s").cast("double"))).drop("_s", "_int")


def profile_enums(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count per allowed member, zero included, and of everything else as ``other``."""
    known = F.array(*[F.struct(F.lit(k).alias("column"), F.lit(m).alias("member")) for k, ms in allowed.items() for m in [*ms, "other"]])
    grid = df.sparkSession.range(1).select(F.explode(known).alias("k")).select("k.*")
    members = F.create_map(*[x for k, ms in allowed.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in ms]))])
    rows = _stacked(df, list(allowed)).where(present(c("value"))).withColumn("_t", canonical(c("value")))
    member = F.when(F.array_contains(F.element_at(members, c("column")), c("_t")), c("_t")).otherwise("other")
    counts = rows.groupBy("column", member.alias("member")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["column", "member"], "left").select("column", "member", F.coalesce("n", F.lit(0)).alias("rows"))


def discover_schema(columns: Sequence[str], fields: Sequence[str], declared: Mapping[str, str], constants: Sequence[str]) -> dict[str, list[str]]:
    """Mapping verdict of a header: set algebra on names, no data is read."""
    blank = [x for x in columns if not x.strip()]
    repeated = sorted({x for x in columns if list(columns).count(x) > 1})
    source = {f: declared.get(f, f) for f in fields}
    mapped = [f for f in fields if f in declared or source[f] in columns]
    return {
        "mapped": mapped, "constants": [f for f in fields if f not in mapped and f in constants],
        "unmapped": [f for f in fields if f not in mapped and f not in constants],
        "unused": sorted(set(columns) - {source[f] for f in mapped}),
        "never_seen": sorted({x for x in declared.values() if x not in columns}), "blank": blank, "repeated": repeated}


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single present value."""
    return _stacked(df, df.columns).groupBy("column").agg(F.count_if(present(c("value"))).alias("present")).where("present = 0").select("column")


class Accumulator(Protocol):
    """User-supplied column measure: partial numbers per batch, merged by ``how`` (sum, min, max)."""

    name: str
    how: str

    def observe(self, values: pd.Series) -> float: ...


def profile_with(df: DataFrame, column: str, accumulators: Sequence[Accumulator]) -> DataFrame:
    """Custom accumulators over one column: Arrow batches reduce in the tasks, Spark merges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"measure": [a.name for a in accumulators], "how": [a.how for a in accumulators],
                                "value": [float(a.observe(pdf[column])) for a in accumulators]})

    partial = df.select(column).mapInPandas(run, "measure string, how string, value double")
    return partial.groupBy("measure", "how").agg(F.sum("value").alias("s"), F.min("value").alias("a"), F.max("value").alias("b")).select(
        "measure", F.when(c("how") == "sum", c("s")).when(c("how") == "min", c("a")).otherwise(c("b")).alias("value"))
