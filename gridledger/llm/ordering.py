"""Places of rows inside sorted groups, found without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions.skew import lookup_join
from gridledger.session import materialize


def numbered(rows: DataFrame, group: str, order: list[Column], place: str, size: str) -> DataFrame:
    """Adds ``place`` (from 0, ascending by ``order`` inside ``group``) and ``size`` (rows of the group).

    ``group`` is a string column without nulls. Rows are dealt out by ranges of
    (group, order) and written once, so a group that holds most rows lies in
    many partitions. What is ordered together afterwards is one row for each
    group and partition: how many rows of the group come before it. Rows that
    are equal in group and order follow each other in some order.
    """
    keys = [F.col(group).asc(), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialize(
        dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "ordered")
    parts = written.groupBy(group, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(parts.select(
        group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias(size)), "ordered-starts")
    found = lookup_join(written, starts, [group, "_part"], ["_seq"], "inner")
    return found.withColumn(place, F.col("_seq") + F.col("_shift")).select(*rows.columns, place, size)
