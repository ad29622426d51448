"""Joins whose left side may hold a large share of its rows under one key.

Adaptive execution splits a skewed join only where both inputs come straight
from a shuffle. A side that was aggregated or ranked on the join key does not,
so these joins split their hot keys themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 1_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
NULL_SPLITS = 4096
STREAM_SPLITS = 16
_HOWS = ("inner", "left", "left_semi", "left_anti")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to the tasks by hash, before costly work inside the row.

    A file is read in few parts, whatever the work costs that its rows make.
    """
    return df.repartition(F.xxhash64(*df.columns))


def hot_keys(df: DataFrame, keys: list[str], name: str, rows: int = ROWS_PER_SPLIT) -> DataFrame:
    """Keys with more than ``rows`` rows and how many splits each needs.

    There are at most count / ``rows`` of them, whatever the data: a result
    that may be broadcast.
    """
    return (
        df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name)).filter(F.col(name) > 1)
    )


def split_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
    rows_per_split: int = ROWS_PER_SPLIT, null_splits: int = NULL_SPLITS,
) -> DataFrame:
    """Join with the hot keys of ``left`` cut into splits of bounded size.

    Only the right rows of hot keys are repeated, once per split; all other
    rows are joined as they are. ``spread_by`` names left columns that differ
    between the rows of a key, so that a task that runs again sends every row
    to the same split. Rows with a null key match nothing and are spread over
    ``null_splits``. The result equals the plain join.
    """
    if how not in _HOWS:
        raise ValueError(f"a join that can split its left side is one of {_HOWS}")
    hot = F.broadcast(hot_keys(left.select(*keys), keys, "_splits", rows_per_split))
    splits = F.coalesce("_splits", F.lit(1))
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    spread = left.join(hot, keys, "left").withColumn(
        "_split", F.pmod(F.xxhash64(*spread_by), F.when(no_key, null_splits).otherwise(splits)).cast("int")
    ).drop("_splits")
    repeated = right.join(hot, keys, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), splits - 1))
    ).drop("_splits")
    return spread.join(repeated, [*keys, "_split"], how).drop("_split")


def lookup_join(
    left: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str], how: str = "left",
    max_rows: int = BROADCAST_ROWS, source: DataFrame | None = None, stream_splits: int = STREAM_SPLITS,
) -> DataFrame:
    """Join to a lookup table that is unique on its keys.

    The table is broadcast when a bounded count shows that it has at most
    ``max_rows`` rows of together ``BROADCAST_BYTES`` as text, and joined by
    split keys otherwise. ``source`` is what the table was reduced from, where
    counting that is cheaper. A stream cannot be counted, so all its keys are
    cut into ``stream_splits`` and the table is repeated as often. Spark's
    estimate knows nothing of the repeats, so that join is told to shuffle.
    """
    counted = (table if source is None else source).limit(max_rows + 1)
    rows, size = counted.agg(
        F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*counted.columns)))), F.lit(0))).first()
    if rows <= max_rows and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(table), keys, how)
    if left.isStreaming:
        split = F.pmod(F.xxhash64(*spread_by), F.lit(stream_splits)).cast("int")
        repeated = table.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(stream_splits - 1))))
        return left.withColumn("_split", split).join(repeated.hint("merge"), [*keys, "_split"], how).drop("_split")
    return split_join(left, table, keys, spread_by, how)
