"""Report rows for dispatchers and planners."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: text a spreadsheet would run as a formula.
FORMULA_LIKE = r"^[\s\p{Cc}]*[=+\-@＝＋－＠]|^[\t\r\n]"


def guarded(column: Column) -> Column:
    return F.when(column.rlike(FORMULA_LIKE), F.concat(F.lit("text:"), column)).otherwise(column)


def export_forecast(df: DataFrame) -> DataFrame:
    """One report row per bucket; guarded text columns are listed by name."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    listed = F.concat_ws(";", *[F.when(F.col(t).rlike(FORMULA_LIKE), F.lit(t)) for t in texts])
    shown = [guarded(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    return df.select(*shown, listed.alias("escaped_text_columns"))


def export_planning(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A total row per bucket, then one row per entry of its ``spatial`` array."""
    total = df.select(*keys, F.lit("total").alias("row_kind"), F.lit(None).cast("bigint").alias("stop_id"),
                      "baseline", "scenario")
    stops = df.select(*keys, F.lit("estimated_stop").alias("row_kind"), F.explode("spatial").alias("s")).select(
        *keys, "row_kind", F.col("s.stop_id").alias("stop_id"), F.col("s.baseline").alias("baseline"),
        F.col("s.scenario").alias("scenario"))
    return total.unionByName(stops)


def export_network(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several route exports under one header."""
    return reduce(DataFrame.unionByName, frames)


def write_report(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(out)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge rows with route sets joined by ``;`` and a GeoJSON text column."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    node_rows = nodes.select(F.lit("node").alias("kind"), F.col("stop_id").alias("a"),
                             F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("length_m"),
                             F.lit("").alias("routes"), point.alias("geometry"))
    a = nodes.select(F.col("stop_id").alias("source"), F.array("lon", "lat").alias("p"))
    b = nodes.select(F.col("stop_id").alias("target"), F.array("lon", "lat").alias("q"))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array("p", "q").alias("coordinates")))
    edge_rows = edges.join(a, "source").join(b, "target").select(
        F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "length_m",
        F.array_join(F.array_sort("routes"), ";").alias("routes"), line.alias("geometry"))
    return node_rows.unionByName(edge_rows)


def write_graph(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    graph_rows(nodes, edges).orderBy("kind", "a", "b").write.mode("overwrite").option("header", True).csv(out)
