"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key (md5 of its id).  Inside a source documents stand in key order; buckets
of the key's first hex digits are summed first, so the prefix sums of word counts are windows over bounded
buckets plus one row per bucket, whatever share of all rows a source holds.  The prefix sums give each source
its exact cut: the key up to which the last, partial epoch reads.  That table has one row per source, and
documents meet it in a join that moves no text.

Defined results: size counts words, a null or empty text has size 0 and takes 0; a null source is a source of
its own, last in order; equal rows (same source, id and text) share a cut evenly, rounded down; a source without words has
target 0; a null doc_id is hashed as the text "null"; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
BUCKET_DIGITS = 3


def measured(documents: DataFrame, seed: str) -> DataFrame:
    """The documents with _size and _key."""
    text = F.coalesce(documents["text"], F.lit(""))
    key = F.concat(F.md5(F.concat(F.coalesce(documents["doc_id"].cast("string"), F.lit("null")), F.lit(":" + seed))),
                   F.lit(":"), F.md5(text))
    return documents.withColumns({"_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_key": key})


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> also target: ``share`` of all words dealt by weight, each at most ``most`` times its source's size.

    Sources in code point order, null last, get the weights in turn.  min(cap, level * weight) is where resharing
    the excess by weight ends; the level follows from sources ordered by cap / weight.  One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", pick).withColumn("_cap", most * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    everything = Window.orderBy("_full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    level = ((share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), none))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), none)))
    leveled = ranked.withColumn("_level", F.when(level <= F.col("_full_at") * (1 + 1e-12), level))
    lowest = F.first("_level", ignorenulls=True).over(everything)
    return leveled.withColumn("_level", F.coalesce(lowest, F.max("_full_at").over(everything))).select(
        "source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def cuts(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, epochs, cut_key, cut_words, from rows (source, _size, _key).

    ``epochs`` whole readings; then documents below ``cut_key`` once more, and ``cut_words`` of each at it.
    """
    units = slim.groupBy("source", "_key").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_copies")).withColumn(
        "_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = slim.groupBy("source", F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = buckets.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    aims = targets(buckets.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    whole = F.floor("target").cast("long")
    aims = aims.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long")),
    }).withColumn("_rest", whole - F.col("epochs") * F.col("source_size"))
    # only the bucket that holds a source's cut is looked into
    hit = based.alias("b").join(aims.select("source", "_rest").alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).where(
        "_rest > 0 AND _base < _rest AND _rest <= _base + _sum").select(F.col("b.source").alias("_source"), "_bucket", "_base", "_rest")
    inner = Window.partitionBy("source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    near = units.alias("u").join(hit.alias("h"), F.col("u.source").eqNullSafe(F.col("h._source")) & (F.col("u._bucket") == F.col("h._bucket"))).select(
        "u.source", "u._bucket", "_key", "_size", "_copies", "_base", "_rest")
    near = near.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    cut = near.where("_before < _rest AND _rest <= _before + _size").select(
        F.col("source").alias("_source"), F.col("_key").alias("cut_key"),
        F.floor((F.col("_rest") - F.col("_before")) / F.col("_copies")).cast("long").alias("cut_words"))
    return aims.join(cut, aims["source"].eqNullSafe(cut["_source"]), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_words")


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with _size and _key, joined to their source's plan; taken: words the mix takes."""
    p = plan.withColumnsRenamed({c: "_plan_" + c for c in plan.columns})
    extra = (F.when(F.col("_plan_cut_key").isNull(), 0).when(F.col("_key") < F.col("_plan_cut_key"), F.col("_size"))
             .when(F.col("_key") == F.col("_plan_cut_key"), F.least("_size", "_plan_cut_words")).otherwise(0)).cast("long")
    return rows.join(p, rows["source"].eqNullSafe(p["_plan_source"]), "left").withColumn("_extra", extra).withColumn(
        "_taken", F.col("_plan_epochs") * F.col("_size") + F.col("_extra"))


def mixing_plan(documents: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim = written(measured(documents, seed).select("doc_id", "source", "_size", "_key"), "mix-sizes")
    return with_taken(slim, written(cuts(slim, **settings), "mix-cuts")).select(
        "doc_id", F.col("_size").alias("size"), F.col("_plan_source_size").alias("source_size"),
        F.col("_plan_target").alias("target"), F.col("_taken").alias("taken"))


def mix(documents: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The documents the mix holds: a row per reading; where a cut falls, the text ends after the words taken
    (joined by single spaces) and n_chars, if there, is its new length.  Documents that are not taken are left out."""
    rows = measured(documents, seed)
    slim = written(rows.select("source", "_size", "_key"), "mix-sizes")
    taken = with_taken(rows, written(cuts(slim, **settings), "mix-cuts"))
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("_taken") - whole * F.col("_size")).cast("int")
    words: Column = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_words")), " ")
    copies = taken.withColumn("_words", F.explode(F.concat(
        F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    cut = copies.withColumn("text", F.when(F.col("_words") < 0, F.col("text")).otherwise(words))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut.select(documents.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') || ':' || md5(coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * n AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, struct_pack(f := cap / weight, s := coalesce(source, chr(1114111)))) AS level FROM l WHERE level <= cap / weight * (1 + 1e-12)),
t AS (SELECT source, CAST(n AS BIGINT) AS n, least(cap, v.level * weight) AS target FROM w, v),
p AS (SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target)::BIGINT // t.n ELSE 0 END AS e,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target, CAST(e * size + greatest(0, least(size, floor(target)::BIGINT - e * n - before)) AS BIGINT) AS taken FROM p
"""
