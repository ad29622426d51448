"""Exact quantiles by distributed selection: ranges are counted, and only the range that holds the rank is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridledger.functions.skew import lookup_join
from gridledger.session import materialize

RANGES = 4096
# A group with at most so many distinct values in its range is ordered by one task.
ORDERED = 100_000
_STATE = ["_group", "_low", "_high", "_from", "_to", "_distinct", "_low_value", "_high_value"]


def _in_range(counted: DataFrame, state: DataFrame) -> DataFrame:
    """The values of undecided groups that lie in the group's range."""
    undecided = state.filter(F.col("_low_value").isNull())
    found = lookup_join(counted, undecided, ["_group"], ["_value"], "inner")
    return found.filter(F.col("_value").between(F.col("_from"), F.col("_to")))


def _holding(cells: DataFrame, order: str) -> DataFrame:
    """Of each group the cells that hold its lower and its upper rank, with the rows before them."""
    running = F.sum("_rows").over(W.partitionBy("_group").orderBy(order))
    placed = cells.withColumn("_before", running - F.col("_rows"))

    def holds(rank: str) -> Column:
        return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_rows"))

    return placed.withColumns({"_has_low": holds("_low"), "_has_high": holds("_high")}).filter("_has_low OR _has_high")


def _narrowed(counted: DataFrame, state: DataFrame, ranges: int) -> DataFrame:
    """One round: the range of each group is cut into ``ranges`` even parts and the one with both ranks is kept.

    If the ranks, which are neighbours, lie in two parts, the last value of the
    one and the first of the other are the result.
    """
    width = F.col("_to").cast("double") - F.col("_from")
    part = F.least(F.lit(ranges - 1), F.floor((F.col("_value") - F.col("_from")) / width * ranges).cast("int"))
    cells = _in_range(counted, state).groupBy("_group", part.alias("_part")).agg(
        F.sum("_n").alias("_rows"), F.min("_value").alias("_least"), F.max("_value").alias("_most"),
        F.count("*").alias("_values"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    held = _holding(cells, "_part").groupBy("_group").agg(
        F.count("*").alias("_parts"), F.min("_before").alias("_before"), F.first("_low").alias("_low"),
        F.first("_high").alias("_high"), F.min("_least").alias("_from"), F.max("_most").alias("_to"),
        F.max("_values").alias("_distinct"),
        F.max(F.when(F.col("_has_low"), F.col("_most"))).alias("_end"), F.max(F.when(F.col("_has_high"), F.col("_least"))).alias("_start"))
    single = (F.col("_parts") == 1) & (F.col("_from") == F.col("_to"))
    apart = F.col("_parts") > 1
    done = state.filter(F.col("_low_value").isNotNull())
    return done.unionByName(held.select(
        "_group", (F.col("_low") - F.col("_before")).alias("_low"), (F.col("_high") - F.col("_before")).alias("_high"),
        "_from", "_to", F.when(apart | single, 0).otherwise(F.col("_distinct")).alias("_distinct"),
        F.when(apart, F.col("_end")).when(single, F.col("_from")).alias("_low_value"),
        F.when(apart, F.col("_start")).when(single, F.col("_from")).alias("_high_value")))


def exact_quantile(
    counted: DataFrame, by: list[str], value: str, n: str, q: float, ranges: int = RANGES, ordered: int = ORDERED,
) -> DataFrame:
    """Quantile ``q`` per group of a table that has each group's distinct values once, with their count.

    Returns ``by``, ``samples`` (sum of counts), ``average`` and ``quantile``,
    interpolated between the two ranks next to it. ``counted`` should be a
    stored table without null values; null keys are a group. Each round reads
    the values in the range that is left, adds them up to at most ``ranges``
    rows per group, and makes the range that many times narrower, so a task
    never holds all distinct values of a group with more than ``ordered``.
    """
    # Without keys the one group is not a literal: the optimiser would drop it from the join keys, and with it the equi-join.
    everything = F.coalesce(F.col(n) - F.col(n), F.lit(0))
    keyed = counted.select(
        (F.struct(*by) if by else F.struct(everything.alias("all"))).alias("_group"), F.col(value).alias("_value"), F.col(n).alias("_n"))
    groups = materialize(keyed.groupBy("_group").agg(
        F.sum("_n").alias("samples"), (F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias("average"),
        F.min("_value").alias("_from"), F.max("_value").alias("_to"), F.count("*").alias("_distinct")), "quantile-groups")
    rank, single = (F.col("samples") - 1) * q, F.when(F.col("_from") == F.col("_to"), F.col("_from"))
    state = groups.select(
        "_group", F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"), "_from", "_to",
        F.when(F.col("_from") == F.col("_to"), 0).otherwise(F.col("_distinct")).cast("long").alias("_distinct"),
        single.alias("_low_value"), single.alias("_high_value")).select(*_STATE)
    while (state.agg(F.max("_distinct")).first()[0] or 0) > ordered:
        state = materialize(_narrowed(keyed, state, ranges).select(*_STATE), "quantile-ranges")
    rest = _in_range(keyed, state).withColumn("_rows", F.col("_n"))
    last = _holding(rest, "_value").groupBy("_group").agg(
        F.max(F.when(F.col("_has_low"), F.col("_value"))).alias("_low_value"),
        F.max(F.when(F.col("_has_high"), F.col("_value"))).alias("_high_value"))
    values = state.filter(F.col("_low_value").isNotNull()).select("_group", "_low_value", "_high_value").unionByName(last)
    share = rank - F.floor(rank)
    quantile = F.when(share == 0, F.col("_low_value")).otherwise((1 - share) * F.col("_low_value") + share * F.col("_high_value"))
    return groups.select("_group", "samples", "average").join(values, "_group").select(
        *[F.col(f"_group.{c}").alias(c) for c in by], "samples", "average", quantile.cast("double").alias("quantile"))
