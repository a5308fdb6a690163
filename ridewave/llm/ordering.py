"""Documents dealt out in doc_id order without sampling them twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_ranges(ids: DataFrame, parts: int) -> Column:
    """An expression over doc_id: the range, 0 .. parts-1, that an id falls into.

    The borders are quantiles of ``ids`` (a narrow table), so ranges hold about equally many rows; the driver
    sees one number for each range.
    """
    shares = [i / parts for i in range(1, parts)]
    borders = sorted(set(ids.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(max(1000, 10 * parts)))).first()[0] or [])) if shares else []
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.lit(borders).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
