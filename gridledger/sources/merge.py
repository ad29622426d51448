"""Keyed merges as DataFrame operations, and the staged write that applies them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.operators.silver import dedupe_events, latest
from gridledger.functions.skew import split_join
from gridledger.session import staged

# About 128 to 256 MB of fact rows.
ROWS_PER_FILE = 2_000_000


def one_per_key(rows: DataFrame, keys: list[str], order_by: list[str], pick) -> DataFrame:
    """One row per key; rows with a null key match nothing, not even each other, and all stay."""
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return pick(rows.filter(named), keys, order_by).unionByName(rows.filter(~named))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Matched keys are replaced, new keys added; the newest of several updates counts.

    A null key never matches: such updates are all added.
    """
    newest = one_per_key(updates, keys, order_by, latest)
    kept = target.join(newest.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(newest.select(*target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Rows whose key is new are added; existing keys stay as they are."""
    return target.unionByName(new_rows(target, rows, keys, order_by).select(*target.columns))


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    first = one_per_key(rows, keys, order_by, dedupe_events)
    return first.join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def upsert_parents(target: DataFrame, docs: DataFrame) -> DataFrame:
    """Parent documents by (contract, version): columns are updated, the parent id is kept."""
    keys = ["contract_id", "document_version_hash"]
    newest = latest(docs, keys, ["ingested_at_timestamp", "parent_id"])
    rest = [c for c in target.columns if c not in [*keys, "parent_id"]]
    old = target.select(*keys, F.col("parent_id").alias("_old_id"), F.struct(*rest).alias("_old"))
    new = newest.select(*keys, F.col("parent_id").alias("_new_id"), F.struct(*rest).alias("_new"))
    merged = old.join(new, keys, "full_outer").select(
        *keys, F.coalesce("_old_id", "_new_id").alias("parent_id"), F.coalesce("_new", "_old").alias("_row")
    )
    return merged.select(*keys, "parent_id", "_row.*").select(*target.columns)


def replace_children(chunks: DataFrame, new: DataFrame, parent_key: str = "parent_id") -> DataFrame:
    """All children of the parents in ``new`` are replaced; a parent with very many children is split."""
    parents = new.select(parent_key).distinct()
    spread_by = [c for c in chunks.columns if c != parent_key]
    kept = split_join(chunks, parents, [parent_key], spread_by, "left_anti")
    return kept.select(*chunks.columns).unionByName(new.select(*chunks.columns))


def ingest_documents(
    parents: DataFrame, chunks: DataFrame, batch_parents: DataFrame, batch_chunks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Re-ingestion: the same version hash replaces its chunks, a new hash adds a version."""
    merged = upsert_parents(parents, batch_parents)
    keys = ["contract_id", "document_version_hash"]
    owned = split_join(batch_chunks.drop("parent_id"), merged.select(*keys, "parent_id"), keys, ["chunk_index"])
    return merged, replace_children(chunks, owned)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_days(spark: SparkSession, path: str, column: str, keep: Callable[[str], bool]) -> DataFrame | None:
    """The folders ``<column>=<date>`` of a table whose ISO date ``keep`` accepts; no other folder is listed or read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    names = [entry.getPath().getName() for entry in system.listStatus(root) if entry.isDirectory()]
    chosen = [n for n in names if n.startswith(f"{column}=") and keep(n.partition("=")[2])]
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in chosen]) if chosen else None


def partition_values(df: DataFrame, column: str) -> list:
    """Distinct values of a partition column: no more than the table has folders."""
    return [row[0] for row in df.select(column).distinct().collect()]


def write_sized(rows: DataFrame, path: str, partition_by: str, keys: list[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Overwrite the partitions of ``rows``, each in files of about ``rows_per_file`` rows.

    Rows are counted per partition first. Each file's rows are brought to one
    task, so a small partition is one file and a large one is written by many
    tasks. ``rows`` should be a stored table; it has no more partition values
    than the table has folders.
    """
    files = rows.groupBy(partition_by).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files")).collect()
    total = sum(r["_files"] for r in files)
    if not total:
        return
    several = {r[partition_by]: r["_files"] for r in files if r["_files"] > 1 and r[partition_by] is not None}
    count = F.lit(1)
    if several:
        known = F.create_map(*[F.lit(x).cast(rows.schema[partition_by].dataType) if i % 2 == 0 else F.lit(x)
                               for pair in several.items() for i, x in enumerate(pair)])
        count = F.coalesce(F.try_element_at(known, F.col(partition_by)), F.lit(1))
    (
        rows.withColumn("_file", F.pmod(F.xxhash64(*keys), count)).repartition(total, partition_by, "_file").drop("_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    )


def merge_into(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order_by: list[str], partition_by: str,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Upsert into a partitioned parquet table, reading and rewriting only touched partitions.

    The partition column must follow from the keys. The merged rows are staged
    in the shared folder first, since a table cannot be overwritten while it
    is read; the stages are deleted once the table is written.
    """
    with staged(one_per_key(updates, keys, order_by, latest), "updates") as newest:
        target = read_if_present(spark, path)
        if target is None:
            return write_sized(newest, path, partition_by, keys, rows_per_file)
        # Literal values prune the folders of the scan.
        touched = target.filter(F.col(partition_by).isin(partition_values(newest, partition_by)))
        old = touched.withColumn(partition_by, F.col(partition_by).cast(newest.schema[partition_by].dataType))
        with staged(upsert(old.select(*newest.columns), newest, keys, order_by), "merge") as merged:
            write_sized(merged, path, partition_by, keys, rows_per_file)
