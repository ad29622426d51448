"""Bottom-k fingerprints of word shingles, and the likeness of a text to its edited form and its neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm.common import SPACE, SPACES, barrier, join_checked, text_of

K = 64
WORDS = 5
SHINGLE_SPACE = 2.0 ** 64
# Neighbours are found inside buckets of about so many documents, in id order.
BUCKET = 2000
CUTS = 64


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE, -1)).otherwise(F.array().cast("array<string>"))


def add_shingles(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """Adds the 64-bit hash of every run of ``words`` words; a text with fewer words is one run, an empty one none.

    Words are hashed once each, runs are hashes of word hashes. Each step is a
    column of its own, so that no step is computed again per shingle.
    """
    hashed, runs = f"{name}_words", F.col(f"{name}_words")
    df = df.withColumn(hashed, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    run = F.transform(
        F.sequence(F.lit(0), F.size(runs) - words),
        lambda i: F.xxhash64(*[F.get(runs, i + j) for j in range(words)]))
    return df.withColumn(
        name, F.when(F.size(runs) >= words, run).when(F.size(runs) > 0, F.array(F.xxhash64(runs)))
        .otherwise(F.array().cast("array<long>"))).drop(hashed)


def add_sketch(df: DataFrame, shingles: str, name: str, k: int = K) -> DataFrame:
    """Replaces ``shingles`` by the sorted ``k`` smallest distinct hashes.

    Hashes are spread evenly, so most of the work is saved by first taking
    those below the level at which 2.5 k are expected; where they turn out to
    be fewer than ``k`` distinct ones, all are sorted. A filter on what comes
    of the sketch stays above it, so the shingles are hashed once.
    """
    level = (F.least(F.lit(1.0), F.lit(2.5 * k) / F.size(shingles)) * SHINGLE_SPACE - SHINGLE_SPACE / 2).cast("long")
    df = df.withColumn(f"{name}_level", level)
    df = df.withColumn(f"{name}_low", F.array_distinct(F.filter(shingles, lambda h: h <= F.col(f"{name}_level"))))
    low = F.col(f"{name}_low")
    sketch = F.when(
        (F.size(low) >= k) | (F.size(shingles) <= 2.5 * k), F.slice(F.array_sort(low), 1, k)
    ).otherwise(F.slice(F.array_sort(F.array_distinct(shingles)), 1, k))
    return df.withColumn(name, barrier(sketch)).drop(f"{name}_low", f"{name}_level", shingles)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all: of the k smallest of both, those found in both.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """
    both = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    reached = (F.element_at(a, -1).cast("double") + SHINGLE_SPACE / 2) / SHINGLE_SPACE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reached)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``: from resemblance and counts, at most 1."""
    like = resemblance(a, b, k)
    shared = like / (1 + like) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(sketches: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of parts. Hashes are made distinct per group before a group's k smallest are taken."""
    rows = sketches.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    first = Window.partitionBy(*keys).orderBy("_hash")
    low = rows.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= k)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(sketch))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _buckets(ids: DataFrame, per_bucket: int) -> Column | None:
    """A bucket number that rises with ``_id``, from at most CUTS quantiles and even steps between them."""
    cuts = ids.agg(F.percentile_approx("_id", [i / CUTS for i in range(1, CUTS)], 10_000)).first()[0]
    if not cuts:
        return None
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    part = F.size(F.filter(bounds, lambda b: b < F.col("_id")))
    spans = ids.groupBy(part.alias("part")).agg(F.min("_id"), F.max("_id"), F.count("*")).collect()
    low, width, steps, base, at = {}, {}, {}, {}, 0
    for row in sorted(spans):
        low[row[0]], width[row[0]] = float(row[1]), float(row[2]) - float(row[1]) + 1.0
        steps[row[0]] = max(1, -(-row[3] // per_bucket))
        base[row[0]] = at
        at += steps[row[0]]
    size = max(low) + 1

    def table(values: dict, default) -> Column:
        return F.get(F.array(*[F.lit(values.get(i, default)) for i in range(size)]), part)

    step = F.floor((F.col("_id") - table(low, 0.0)) / table(width, 1.0) * table(steps, 1))
    return (table(base, 0) + F.least(F.greatest(step, F.lit(0)), table(steps, 1) - 1)).cast("long")


def with_next(docs: DataFrame, columns: list[str], per_bucket: int = BUCKET) -> DataFrame:
    """Adds ``next_<column>`` of the next row by descending ``doc_id``; the last row is followed by the first.

    Rows of equal id follow each other by their columns. Null ids come last. A
    single row is its own next. Rows meet in buckets of consecutive ids, and
    the first row of a bucket is lent to the bucket before, so each row is
    moved once and no task holds more than a bucket. Only bucket heads, one
    for each 2,000 rows, are ordered together.
    """
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-2 ** 63)).cast("long"))
    bucket = _buckets(rows.select("_id"), per_bucket)
    if bucket is None:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    rows = rows.withColumn("_bucket", bucket)
    heads = rows.groupBy("_bucket").agg(F.max("_id").alias("_id"))
    order = Window.orderBy("_bucket")
    lowest = F.min("_bucket").over(Window.partitionBy())
    highest = F.max("_bucket").over(Window.partitionBy())
    above = F.when(F.col("_bucket") == highest, lowest).otherwise(F.lead("_bucket").over(order))
    lent = join_checked(
        rows.drop("_bucket"), heads.select("_id", above.alias("_bucket")), ["_id"], "inner")
    both = rows.withColumn("_lent", F.lit(0)).unionByName(lent.withColumn("_lent", F.lit(1)))
    follow = Window.partitionBy("_bucket").orderBy("_lent", F.col("_id").desc(), *columns)
    return both.withColumns({f"next_{c}": F.lead(c).over(follow) for c in columns}).filter("_lent = 0").drop(
        "_lent", "_bucket", "_id")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of each text and of its edited form, and their likeness.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. The
    edited text has its last floor(n / 2) code points replaced by the first as
    many of the next document in descending id, or by all of that if it is
    shorter. A null text counts as empty; an empty text has the empty
    fingerprint. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_shingles`` (estimated) and
    ``inside_edited`` (estimated share of the shingles that the edit left).
    """
    rows = docs.select("doc_id", text_of().alias("_text"))
    rows = add_sketch(add_shingles(rows, "_text", "_shingles"), "_shingles", "_sketch", k)
    rows = with_next(rows, ["_text", "_sketch"])
    rows = rows.withColumn("_n", F.length("_text")).withColumn("_half", F.floor(F.col("_n") / 2).cast("int"))
    rows = rows.withColumn("_edited", F.concat(
        F.substring("_text", F.lit(1), F.col("_n") - F.col("_half")),
        F.substring("next__text", F.lit(1), F.col("_half"))))
    rows = add_sketch(add_shingles(rows, "_edited", "_edited_shingles"), "_edited_shingles", "_edited_sketch", k)
    own, edited, following = F.col("_sketch"), F.col("_edited_sketch"), F.col("next__sketch")
    return rows.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        resemblance(own, edited, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
        distinct_shingles(own, k).alias("n_shingles"), containment(own, edited, k).alias("inside_edited"))
