"""Places and running sums in the order of a whole table, which no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import keep


def in_order(rows: DataFrame, *by: Column | str, place: str = "place", sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of ``by``, and for each of ``sums`` the running sum of its column up to the row.

    Rows are dealt to ranges of ``by``, sorted there and written; places and sums within a range
    then start from what all ranges before it come to. Only a row for each range meets the others.
    Among rows with equal ``by`` the order is any, but one.
    """
    sums = sums or {}
    ranged = rows.withColumns({f"__v{i}": v for i, v in enumerate(sums.values())}) if sums else rows
    at = F.monotonically_increasing_id()
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", at)
    kept = keep(ranged, "ranges").withColumn("__part", F.shiftright("__id", 33))
    totals = kept.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sums))])
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__from{c}") for c in totals.columns[1:]])
    joined = kept.join(F.broadcast(starts), "__part")  # a row for each range
    out = joined.withColumn(place, F.col("__from__n") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    upto = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if sums:
        out = out.withColumns({name: F.col(f"__from__s{i}") + F.coalesce(F.sum(f"__v{i}").over(upto), F.lit(0)) for i, name in enumerate(sums)})
    return out.select(*[f"`{c}`" for c in rows.columns], place, *sums)
