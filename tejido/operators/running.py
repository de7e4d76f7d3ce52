"""Running totals over an order, without bringing all rows to one task.

Rows have a place (a long, each once). Places are cut into blocks of a fixed width; blocks are added up, and their running totals are found in the
same way, by blocks of blocks, until so few are left that they can be added up at the driver. A window then works within a block,
which holds so many rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block, and blocks that are added up at the driver at most.
WIDTH = 4096


def before(rows: DataFrame, place: str, counts: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """rows with a column for each count: its sum over all rows of smaller places. Places are not below zero."""
    named = rows.withColumns({f"_own_{k}": c for k, c in counts.items()}).withColumn("_block", F.floor(F.col(place) / width))
    totals = named.groupBy("_block").agg(*(F.sum(f"_own_{k}").alias(f"_own_{k}") for k in counts))
    kinds = [f"_own_{k}" for k in counts]
    if (totals.agg(F.max("_block")).first()[0] or 0) >= width:
        inner = before(totals.select(F.col("_block").alias("_outer"), *(F.col(f"_own_{k}").alias(f"_sum_{k}") for k in counts)), "_outer", {k: F.col(f"_sum_{k}") for k in counts}, width)
        offsets = inner.select(F.col("_outer").alias("_block"), *(F.col(k).alias(f"_before_{k}") for k in counts))
    else:
        found, sums = [], dict.fromkeys(kinds, 0)
        for r in sorted(totals.collect(), key=lambda r: r["_block"]):
            found.append((r["_block"], *sums.values()))
            sums = {k: sums[k] + (r[k] or 0) for k in kinds}
        offsets = rows.sparkSession.createDataFrame(found, ", ".join(["_block long", *(f"_before_{k} long" for k in counts)]))
    inside = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    summed = named.join(offsets, "_block").withColumns({k: F.col(f"_before_{k}") + F.coalesce(F.sum(f"_own_{k}").over(inside), F.lit(0)) for k in counts})
    return summed.drop("_block", *kinds, *(f"_before_{k}" for k in counts))
