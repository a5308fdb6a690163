"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and go.

A HyperLogLog sketch of the sites is kept per line hash; sketches of map tasks merge by aggregation, so a
line that a third of all documents hold costs one sketch a task.  An estimate far above or far below the
threshold decides alone; lines within ``margin`` standard errors of it get an exact distinct count.  So the
result equals exact counting.

Defined results: lines are trimmed of blanks, empty lines are never removed; a null text has no lines; a null
site counts as one site of its own; repeated rows count once a site and are all cut alike; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import input_documents, restored_id, text_key, written


def line_list() -> Column:
    return F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def widespread_lines(lines: DataFrame, min_sites: int, precision: int = 12, margin: float = 5.0) -> DataFrame:
    """line (hash): lines of ``lines`` (line, site) on ``min_sites`` sites or more."""
    sketched = written(lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(precision))).alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - margin * 1.04 / 2 ** (precision / 2)) - 0.5), "line-sites")
    far = min_sites * (1 + margin * 1.04 / 2 ** (precision / 2)) + 0.5
    near = sketched.where(F.col("sites") <= far).select("line")
    exact = (lines.join(near, "line").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    return sketched.where(F.col("sites") > far).select("line").unionByName(exact.select("line"))


def line_dedup(documents: DataFrame, site: str = "source", min_sites: int = 5, **settings) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept (its text without boilerplate lines)."""
    texts = input_documents(documents, site).withColumn("text_key", text_key())
    placed = texts.select("doc_id", "text_key", F.coalesce(F.col(site), F.lit("\x00")).alias("site"),
                          F.posexplode(line_list()).alias("place", "words")).where("words <> ''").select(
        "doc_id", "text_key", "site", "place", F.xxhash64("words").alias("line"))
    spread = widespread_lines(placed.select("line", "site"), min_sites, **settings)
    gone = (placed.select("line", "doc_id", "text_key", "place").join(spread, "line")
            .groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("gone")))
    lines = texts.select("doc_id", "text_key", "text").join(gone, ["doc_id", "text_key"], "left").withColumn("lines", line_list())
    kept = F.filter("lines", lambda x, i: F.coalesce(~F.array_contains("gone", i), F.lit(True)))
    return lines.select(
        restored_id(), F.size(F.filter("lines", lambda x: x != "")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long")).alias("n_removed"), F.array_join(kept, "\n").alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS site, list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS lines FROM documents),
l AS (SELECT DISTINCT unnest(lines) AS line, site FROM d),
b AS (SELECT list(line) AS gone FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 5))
SELECT doc_id, len(list_filter(lines, lambda x: x <> '')) AS n_lines, len(list_filter(lines, lambda x: list_contains(gone, x))) AS n_removed,
  sha256(array_to_string(list_filter(lines, lambda x: NOT list_contains(gone, x)), chr(10))) AS kept_sha256
FROM d, (SELECT coalesce(max(gone), []) AS gone FROM b)
"""
