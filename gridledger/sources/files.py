"""File scans: snapshots, JSON, case packages, documents and runtime events."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.functions.scalars import mime_type
from gridledger.profiles import CASE_SCHEMA, RUNTIME_EVENT_SCHEMA
from gridledger.session import materialize, shared_folder

# Single files that a task reads, and what it hands on at once.
FILES_PER_TASK = 2000
_BATCH_FILES = 1000
_BATCH_BYTES = 8 * 1024 * 1024


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Delimited snapshot with a header that must name the schema's columns; names are lower-cased."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.toDF(*[c.lower() for c in df.columns])


def land_snapshot(spark: SparkSession, source: str, target: str, schema: T.StructType) -> None:
    """Copy a delimited snapshot to parquet, all text as delivered."""
    scan_csv(spark, source, schema).write.mode("overwrite").parquet(target)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file named in an extract manifest."""
    systems = T.ArrayType(T.StructType([
        T.StructField("source_system", T.StringType()),
        T.StructField("landing_zone", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]))
    schema = T.StructType([
        T.StructField("extract_id", T.StringType()),
        T.StructField("extract_timestamp_utc", T.StringType()),
        T.StructField("source_systems", systems),
    ])
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select("extract_id", F.inline("source_systems"))
        .select("extract_id", "source_system", "landing_zone", F.explode("files").alias("file_name"))
    )


def land_from_manifest(
    spark: SparkSession, manifest: str, source_root: str, target_root: str, schemas: dict[str, T.StructType]
) -> list[str]:
    """Land every file of a manifest below its landing zone; returns the tables written."""
    written = []
    # A manifest names a handful of files; only these names reach the driver.
    for row in scan_manifest(spark, manifest).collect():
        table = row.file_name.rsplit(".", 1)[0]
        target = f"{target_root}/{row.landing_zone}/{table}"
        land_snapshot(spark, f"{source_root}/{row.file_name}", target, schemas[table])
        written.append(target)
    return written


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_case_packages(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """Case packages from one object, a list, or an object with a ``cases`` array."""
    wrapped = T.StructType(schema.fields + [T.StructField("cases", T.ArrayType(schema))])
    raw = spark.read.schema(wrapped).option("multiLine", True).json(path)
    own = F.struct(*schema.names)
    listed = F.when(F.col("cases").isNotNull(), F.col("cases")).otherwise(F.array(own))
    return raw.select(F.inline(listed))


def _hidden(name: str) -> bool:
    """What Spark's file sources leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _paths(names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files below each folder, without empty ones; of one that is not ``deep`` its own files only."""
    found = []
    for batch in batches:
        for row in batch.to_pylist():
            waiting = [row["folder"]]
            while waiting:
                with os.scandir(waiting.pop()) as entries:
                    for entry in entries:
                        if _hidden(entry.name):
                            continue
                        if entry.is_dir():
                            waiting.extend([entry.path] if row["deep"] else [])
                        elif entry.stat().st_size:
                            found.append(entry.path)
                        if len(found) >= _BATCH_FILES:
                            yield _paths(found)
                            found = []
    yield _paths(found)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed():
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    names, contents, held = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb", buffering=0) as file:
                content = file.readall()
            if names and held + len(content) > _BATCH_BYTES:
                yield packed()
                names, contents, held = [], [], 0
            names.append(f"file:{path}")
            contents.append(content)
            held += len(content)
    yield packed()


def _folder_contents(spark: SparkSession, root: str) -> DataFrame:
    """Path and bytes of every file below a mounted folder, listed and read by tasks; no list of files reaches the driver."""
    with os.scandir(root) as entries:
        folders = [(entry.path, True) for entry in entries if entry.is_dir() and not _hidden(entry.name)]
    folders = spark.createDataFrame([(root, False), *folders], "folder string, deep boolean")
    dealt = folders.repartition(spark.sparkContext.defaultParallelism * 4, "folder")
    listed = materialize(dealt.mapInArrow(_list_folders, "path string"), "listed")
    tasks = max(spark.sparkContext.defaultParallelism, -(-listed.count() // FILES_PER_TASK))
    return listed.repartition(tasks, "path").mapInArrow(_read_files, "path string, content binary")


def scan_documents(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Text files, one row each, with their content hash; joined to a manifest by file name.

    ``path`` is a folder, whose files are taken at any depth, or a glob. The
    files of a folder that all machines mount are listed and read by tasks; a
    glob and other stores go through Spark's listing, which keeps all names on
    the driver. The version hash is taken from the bytes of the file; bytes that are not
    UTF-8 are replaced in the text.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    root = shared_folder(spark, path)
    if root is not None and os.path.isdir(root):
        raw = _folder_contents(spark, root)
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    docs = raw.select(
        "path",
        name.alias("source_file_name"),
        F.sha2("content", 256).alias("document_version_hash"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("raw_text_content"),
    ).withColumn("source_mime_type", mime_type("source_file_name"))
    if manifest is None:
        return docs
    named = manifest.withColumn("source_file_name", F.element_at(F.split(F.col("text_path"), "/"), -1))
    return docs.join(named, "source_file_name")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """Runtime events from JSON lines; free metrics and attributes become text maps."""
    return spark.read.schema(RUNTIME_EVENT_SCHEMA).json(path)
