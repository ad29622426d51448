"""Exact de-duplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import SPACE, join_groups, text_of
from gridledger.session import materialize

SALTS = 16


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _contents(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id"), normalised().alias("_text"))
    return rows.withColumn("_digest", digest(F.col("_text")))


def content_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct normalised text: ``_digest, _text, keep_id, group_size``.

    Three stages, each of which compares digest and whole text:

    1. inside each input partition, as the map side of the first aggregate;
    2. per (digest, salt), where the salt is the partition's, so the copies of
       a hot text are merged by ``salts`` tasks;
    3. per digest, over at most ``salts`` rows of each text.
    """
    salted = _contents(docs, digest).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("_digest", "_salt", "_text").agg(
        F.min("doc_id").alias("_first"), F.count("*").alias("_rows"))
    # Rows of one digest meet, so that texts which share a digest can be told apart below.
    return winners.repartition("_digest").groupBy("_digest", "_text").agg(
        F.min("_first").alias("keep_id"), F.sum("_rows").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row of ``docs`` the row that stays for its text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Texts
    are equal when identical after each run of ASCII white space became one
    space; a null text equals the empty one. Returns ``doc_id, keep_id``
    (smallest id of the group), ``group_size`` (rows, repeated ones counted),
    ``kept`` (``doc_id`` = ``keep_id``) and ``text_sha256``. Rows that repeat
    the smallest id are all marked kept. A null id is kept only in a group
    without other ids. No rows give no rows.

    A digest that two texts share is resolved by comparing the texts.
    """
    by_digest = content_groups(docs, salts, digest).groupBy("_digest").agg(
        F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("_texts"),
        F.sum("group_size").alias("_rows"))
    # Only digests with several rows decide anything for another row.
    groups = materialize(by_digest.filter("_rows > 1"), "exact-groups")
    total = docs.count()
    rows = _contents(docs, digest).select("doc_id", "_digest", sha256(F.col("_text")).alias("text_sha256"))
    if groups.filter("_texts > 1").isEmpty():
        found = join_groups(rows, groups.drop("_texts"), "_digest", "_rows", total, "doc_id")
    else:
        found = _compared(docs, digest, groups, rows, total, salts)
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256")


def _compared(docs, digest, groups, rows, total, salts) -> DataFrame:
    """The same for digests that several texts share: their rows are joined by the texts themselves."""
    shared = groups.filter("_texts > 1").select("_digest")
    clear = join_groups(
        rows.join(shared, "_digest", "left_anti"), groups.filter("_texts = 1").drop("_texts"), "_digest", "_rows",
        total, "doc_id")
    texts = content_groups(docs, salts, digest).join(shared, "_digest", "left_semi").withColumn(
        "_rows", F.col("group_size")).drop("_digest")
    mixed = _contents(docs, digest).join(shared, "_digest", "left_semi").withColumn(
        "text_sha256", sha256(F.col("_text")))
    resolved = join_groups(mixed, texts, "_text", "_rows", total, "doc_id")
    return clear.unionByName(resolved.drop("_text"))
