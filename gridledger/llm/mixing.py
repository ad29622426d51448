"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm.common import SPACE, join_groups, text_of
from gridledger.session import materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
ROWS_PER_BUCKET = 4096


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def seeded(seed: str) -> Column:
    """A fixed random order of the documents: equal ids get equal places."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to a table of sources with ``source`` and ``source_size``.

    Sources in code point order, null last, take ``weights`` in turn and share
    the sum of all sizes. A share above ``max_epochs`` times the source is
    clamped there and the excess is shared again by weight. In the order of
    cap / weight the clamped sources come first, so the level of the others is
    the largest of (rest of the sum) / (rest of the weights) over all places.
    The table has one row per source; its windows run over these rows only.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    given = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    given = given.withColumn("_cap", F.col("source_size") * max_epochs)
    order = [F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    filled = given.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight"))
    return filled.withColumn("target", target).drop("_weight", "_cap", "_level")


def _plan(sizes: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source: target, whole repetitions, and where in the seeded order the last, fractional one ends.

    The order is cut into buckets of some 4,096 documents by the first digits
    of the seeded value. Sums of buckets find the bucket in which the
    fraction ends; only the documents of that bucket are put in order.
    """
    sources = sizes.groupBy("_key", "source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    filled = water_fill(sources, max_epochs, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_rows") / ROWS_PER_BUCKET))).cast("int")
    filled = materialize(
        filled.withColumn("_epochs", epochs.cast("long"))
        .withColumn("_extra", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_digits", digits), "mix-sources")
    total = filled.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    cut = join_groups(
        sizes, filled.select("_key", "_rows", "_extra", "_digits"), "_key", "_rows", total, "doc_id"
    ).withColumn("_bucket", F.expr("substring(_place, 1, _digits)"))
    sums = cut.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"), F.first("_extra").alias("_extra"))
    upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        sums.withColumn("_upto", F.sum("_words").over(upto))
        .filter("_upto > _extra AND _upto - _words <= _extra")
        .select("_key", "_bucket", (F.col("_upto") - F.col("_words")).alias("_start")))
    # Rows that repeat an id stand at one place and are cut together.
    places = cut.join(last, ["_key", "_bucket"]).groupBy("_key", "_bucket", "_place", "_start", "_extra").agg(
        F.sum("size").alias("_words"))
    running = Window.partitionBy("_key", "_bucket").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = (
        places.withColumn("_upto", F.col("_start") + F.sum("_words").over(running))
        .filter("_upto > _extra AND _upto - _words <= _extra")
        .select("_key", F.col("_place").alias("_last_place"), F.col("_words").alias("_last_words"),
                (F.col("_extra") - (F.col("_upto") - F.col("_words"))).alias("_last_extra")))
    return materialize(filled.drop("source", "_digits").join(ends, "_key", "left"), "mix-plan")


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        "doc_id", "source", _source_key().alias("_key"), words_in(text_of()).cast("long").alias("size"),
        seeded(seed).alias("_place"))


def mixed(
    docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs ``doc_id, text, source``; other columns are not read.
    Returns ``doc_id, size, source_size, target`` (the source's) and
    ``taken``. Every document is taken whole as often as its source's target
    holds the source; the rest goes to the documents first in an order by
    seed and id, of which the last is taken in part, so a source's words meet
    its target but for rounding. Rows that repeat the id of that last
    document share its part. A null or empty text has size 0; a null source
    is a source of its own; a null id is an id like others. No rows give none.
    """
    sizes = materialize(_sizes(docs, seed), "mix-sizes")
    plan = _plan(sizes, max_epochs, weights)
    total = sizes.count()
    rows = join_groups(sizes, plan, "_key", "_rows", total, "doc_id")
    extra = (
        F.when(F.col("_last_place").isNull(), F.lit(0))
        .when(F.col("_place") < F.col("_last_place"), F.col("size"))
        .when(F.col("_place") == F.col("_last_place"),
              F.floor(F.col("_last_extra") * F.col("size") / F.col("_last_words")))
        .otherwise(0))
    return rows.select(
        "doc_id", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + extra).cast("long").alias("taken"))


def repeated(
    docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED,
) -> DataFrame:
    """The mix as documents: each row of ``docs``, whole, as often as it is taken.

    The document at which the fraction of a source ends is taken once more if
    at least half of it belongs to the mix.
    """
    sizes = materialize(_sizes(docs, seed), "mix-sizes")
    plan = _plan(sizes, max_epochs, weights).select(
        F.col("_key"), F.col("_rows"), F.struct("_epochs", "_last_place", "_last_extra", "_last_words").alias("_mix"))
    total = sizes.count()
    rows = docs.withColumns({"_key": _source_key(), "_place": seeded(seed)})
    once_more = (F.col("_place") < F.col("_mix._last_place")) | (
        (F.col("_place") == F.col("_mix._last_place")) & (F.col("_mix._last_extra") * 2 >= F.col("_mix._last_words")))
    times = F.col("_mix._epochs") + F.when(F.coalesce(once_more, F.lit(False)), 1).otherwise(0)
    taken = join_groups(rows, plan, "_key", "_rows", total, "doc_id").withColumn("_times", times.cast("int"))
    return taken.filter("_times > 0").withColumn(
        "_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
