"""What the text operators share: null rules, held-out rows, joins whose sides are checked for size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, as the words of all operators are cut.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
# A group with more than rows / HOT_GROUPS rows is hot: there are fewer than
# HOT_GROUPS of them, whatever the data, so their table may be broadcast.
HOT_GROUPS = 4096
SMALL_TABLE = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a worker; after each, what Arrow keeps of freed memory goes back to the machine."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(folds: int = 5) -> Column:
    """True for every ``folds``-th document by the CRC-32 of its id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def barrier(column: Column) -> Column:
    """The same values, below which no filter is moved and into which no later expression is merged.

    Spark moves a filter below a projection by writing the filtered expression
    out again, lambdas and all, unless the projection is not deterministic. The
    partition number makes it so, though it never changes a value.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def is_small(table: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a bounded count shows at most ``max_rows`` rows of together ``max_bytes`` as text."""
    sizes = table.select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
    rows, size = sizes.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str, max_rows: int = 2_000_000) -> DataFrame:
    """Join that broadcasts ``right`` only if a count shows it to be small in rows and bytes, and shuffles otherwise."""
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    return left.join(right, keys, how)


def join_groups(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """Left join with ``groups``, unique on the string column ``key``, when a few groups may hold most rows.

    Groups with more than ``total`` / 4,096 rows, at most 4,096 of them, are
    broadcast. Their rows go on under keys of their own, made from ``spread``,
    so no task of the second join gets more than an even share of one group.
    A table that a count shows to be small is broadcast whole.
    """
    if is_small(groups, SMALL_TABLE):
        return left.join(F.broadcast(groups), key, "left").select(
            *left.columns, *[c for c in groups.columns if c != key])
    values = F.struct(*[c for c in groups.columns if c != key])
    is_hot = F.col(size) * HOT_GROUPS > total
    hot = groups.filter(is_hot).select(key, values.alias("_hot"))
    rest = groups.filter(~is_hot).select(F.col(key).alias("_rest_key"), values.alias("_rest"))
    own = F.concat(F.lit("resolved:"), F.xxhash64(spread).cast("string"))
    found = left.join(F.broadcast(hot), key, "left").withColumn(
        "_rest_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own))
    joined = found.join(rest, "_rest_key", "left").withColumn("_group", F.coalesce("_hot", "_rest"))
    return joined.select(*left.columns, *[F.col(f"_group.{c}").alias(c) for c in groups.columns if c != key])
