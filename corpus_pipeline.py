"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import bpe, dedup, language, mixing, neardup
from gridledger.llm.common import join_checked, read
from gridledger.session import materialize


_KEY = ["_a", "_b"]


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns a stage works on, and the other given columns, whatever their names, in one of their own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in columns]
    return docs.select(*columns, F.struct(*others or [F.lit(0)]).alias("_given"))


def _as_given(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with the columns of ``docs``; no stage changes those it works on."""
    return rows.select(*[F.col(c) if c in columns else F.col("_given").getField(c).alias(c) for c in docs.columns])


def _key(digest: Column) -> list[Column]:
    """128 bits of the id, null or not, and the digest of the normalised text."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), digest).alias(name) for seed, name in enumerate(_KEY)]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", *_key(dedup.sha256(dedup.normalised())))


def _once(keyed: DataFrame) -> DataFrame:
    """One row of each key. Only rows whose key a count finds twice are compared."""
    repeated = materialize(keyed.groupBy(*_KEY).count().filter("count > 1").select(*_KEY), "repeated-keys")
    if repeated.isEmpty():
        return keyed
    again = join_checked(keyed, repeated, _KEY, "left_semi").select(*keyed.columns)
    single = join_checked(keyed, repeated, _KEY, "left_anti").select(*keyed.columns)
    return single.unionByName(again.dropDuplicates(_KEY))


def _with_own_ids(docs: DataFrame) -> DataFrame:
    """``docs``, unique by id and text, with ids of their own: rows without id, or all but one that repeat an id, follow the largest."""
    keyed = _keyed(docs)
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    ids = materialize(ids, "repeated-ids")
    nulls = keyed.filter("doc_id IS NULL").select("doc_id", *_KEY)
    again = join_checked(keyed.select("doc_id", *_KEY), ids, ["doc_id"], "left_semi").select("doc_id", *_KEY)
    firsts = again.groupBy("doc_id").agg(F.min(F.struct(*_KEY)).alias("_first")).select("_first.*")
    odd = materialize(nulls.unionByName(again.join(firsts, _KEY, "left_anti").select("doc_id", *_KEY)), "odd-rows")
    if odd.isEmpty():
        return docs.withColumn("_own", F.col("doc_id"))
    least = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    ordered = odd.orderBy(F.col("doc_id").asc_nulls_last(), *_KEY)
    own = materialize(ordered.select(*_KEY, (F.monotonically_increasing_id() + F.lit(least)).alias("_new")), "own-ids")
    named = join_checked(keyed, own, _KEY, "left").select(*docs.columns, F.coalesce("_new", "doc_id").alias("_own"))
    return materialize(named, "own-rows")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not in any language of the labelled ones go: no letter, or far from all centroids.

    So null and empty texts go; without any labelled row all go. Repeated rows
    are decided alike, and no rows give none. All given columns stay as they are.
    """
    own = "doc_id", "text", "lang"
    return _as_given(language.without_rejected(_apart(docs, *own)), docs, *own)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows with equal text one with the smallest id stays; rows without id come last.

    A null text equals the empty one. Of rows that repeat id and text one
    stays. No rows give none. All given columns stay as they are.
    """
    own = "doc_id", "text"
    rows = _keyed(_apart(docs, *own))
    kept = dedup.exact_groups(docs).filter("kept").select(*_key(F.col("text_sha256"))).distinct()
    return _as_given(_once(join_checked(rows, kept, _KEY, "left_semi")), docs, *own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays; rows without id, or that repeat an id, come last.

    Null and empty texts are linked with nothing and stay. Of rows that repeat
    id and text one stays. No rows give none. All given columns stay as they are.
    """
    own = _with_own_ids(_once(_keyed(_apart(docs, "doc_id", "text"))).select("doc_id", "text", "_given"))
    named = own.select(F.col("_own").alias("doc_id"), "text")
    kept = neardup.near_components(named).filter("kept").select(F.col("doc_id").alias("_own"))
    return _as_given(join_checked(own, kept, ["_own"], "left_semi"), docs, "doc_id", "text")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets.

    Rows that repeat an id are taken alike; a null source is a source of its
    own; null and empty texts have no words and are taken with their source's
    whole repetitions. No rows give none. All given columns stay as they are.
    """
    own = "doc_id", "text", "source"
    return _as_given(mixing.repeated(_apart(docs, *own)), docs, *own)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of decoded bytes: one row for each row, repeated or not.

    A null text counts as empty and has no ids. No rows give none.
    """
    return bpe.encoded(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]
# Centroids and byte-pair merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
