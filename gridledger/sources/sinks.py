"""Writers and table registration."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.session import discard, shared_folder

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){1,2}")


def check_table_name(name: str) -> str:
    """Two or three plain identifiers; anything else is refused."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"invalid table name: {name}")
    return name


def write_outcomes(validated: DataFrame, path: str, mode: str = "append") -> None:
    """Valid and quarantined rows in one pass, below ``outcome=valid`` and ``outcome=quarantine``."""
    outcome = F.when(F.col("validation_error_code").isNull(), "valid").otherwise("quarantine")
    validated.withColumn("outcome", outcome).write.mode(mode).partitionBy("outcome").parquet(path)


def write_clustered(
    df: DataFrame, path: str, by: list[str], ranges: int | None = None, mode: str = "overwrite",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Parquet sorted by ranges of ``by``, so that filters on the first column skip files.

    Name a second column that differs within the first: a value of the first
    column that holds much of the data is then cut into several ranges.
    Without ``ranges`` their number follows from the size of the data. Columns
    that ``finish`` adds to the sorted rows, row by row, are not shuffled.
    """
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    rows = ranged.sortWithinPartitions(*by)
    (finish(rows) if finish else rows).write.mode(mode).parquet(path)


def _single_files(root: str, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes each text below the task's own folder and moves the whole folders to ``root`` at the end.

    A folder that is there already comes from another attempt of the task, with the same rows.
    """
    def write(batches):
        task, count, opened = TaskContext.get(), 0, {}
        own = f"{root}/_temporary/{task.taskAttemptId()}"
        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if value not in opened:
                    opened[value] = f"{own}/{folder}={value}"
                    os.makedirs(opened[value])
                with open(f"{opened[value]}/part-{task.partitionId():05d}-{count:08d}.txt", "xb", buffering=0) as file:
                    _write_all(file, (text.as_py() or b"") + b"\n")
                count += 1
        for value, path in opened.items():
            try:
                os.rename(path, f"{root}/{folder}={value}")
            except OSError:
                if not os.path.isdir(f"{root}/{folder}={value}"):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    return write


def _write_all(file, content: bytes) -> None:
    rest = memoryview(content)
    while rest:
        rest = rest[file.write(rest):]


def write_single_files(rows: DataFrame, path: str, folder: str) -> None:
    """The ``text`` of every row, and a line end, as a file of its own below ``<folder>=<value>``; a null text counts as empty.

    All rows of a folder must come in one task. Where all machines mount the
    store, tasks write the files themselves: Hadoop's local file system starts
    a process for the rights of each file and of its checksum.
    """
    spark = rows.sparkSession
    root = shared_folder(spark, path)
    if root is None:
        rows.select(folder, "text").write.option("maxRecordsPerFile", 1).partitionBy(folder).text(path)
        return
    os.makedirs(root)
    rows.select(folder, F.col("text").cast("binary")).mapInArrow(_single_files(root, folder), "files long").agg(F.sum("files")).collect()
    discard(spark, f"{path}/_temporary")
    open(f"{root}/_SUCCESS", "xb").close()


def register(df: DataFrame, name: str, mode: str = "error", path: str | None = None) -> None:
    """Save as a table of the catalog, below the warehouse or at ``path``."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(check_table_name(name))


def export_breach_json(breaches: DataFrame, path: str) -> None:
    breaches.write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def get_cases(cases: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Cases by id, the evidence as JSON text beside the other columns."""
    if isinstance(ids, list):
        wanted = cases.filter(F.col("breach_event_id").isin(ids))
    else:
        wanted = cases.join(ids.select("breach_event_id").distinct(), "breach_event_id", "left_semi")
    return wanted.withColumn("evidence_context_json", F.to_json("evidence_context")).drop("evidence_context")


def get_case(cases: DataFrame, case_id: str) -> DataFrame:
    return get_cases(cases, [case_id]).limit(1)


def restore_evidence(cases: DataFrame, evidence_type) -> DataFrame:
    """The JSON text back to an array; missing text is an empty array."""
    parsed = F.from_json("evidence_context_json", evidence_type)
    return cases.withColumn(
        "evidence_context", F.coalesce(parsed, F.array().cast(evidence_type))
    ).drop("evidence_context_json")
