"""Stretches of values, so that running totals go over stretches first and inside each then: no window holds all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stretches of about as many rows each.
CELLS = 256


def with_cells(rows: DataFrame, value: str, out: str, cells: int = CELLS) -> DataFrame:
    """rows (value not null) with `out`, the stretch that holds the value; cuts are approximate quantiles, whatever the values' scale."""
    at = rows.withColumn("_v", F.col(value).cast("double"))
    cuts = sorted({c for c in at.approxQuantile("_v", [i / cells for i in range(1, cells)], 0.5 / cells) if abs(c) < float("inf")})
    got = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(at)
    return got.withColumn(out, F.col("_b").cast("int")).drop("_v", "_b")


def running(levels: DataFrame, value: str, cell: str, count: str, by: list[str] = ()) -> DataFrame:
    """levels, a row for each value (of each group), with _before: the sum of `count` over the smaller values of the group.

    Totals of stretches, at most CELLS + 1 a group, give offsets; the rest is summed inside stretches.
    """
    totals = levels.groupBy(*by, cell).agg(F.sum(count).alias("_cell_sum"))
    before = F.coalesce(F.sum("_cell_sum").over(W.partitionBy(*by).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"_on{i}" for i, c in enumerate((*by, cell))}
    offsets = totals.select(*by, cell, before.alias("_offset")).withColumnsRenamed(names)
    own = F.coalesce(F.sum(count).over(W.partitionBy(*by, cell).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.withColumn("_own", own)
    joined = ranked.join(offsets, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
    return joined.withColumn("_before", F.col("_own") + F.col("_offset")).drop("_own", "_offset")
