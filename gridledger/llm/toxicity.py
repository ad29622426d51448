"""Toxicity from two Kneser-Ney models, one of toxic and one of ordinary documents, with shared backoff."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.skew import split_join
from gridledger.llm.common import held_out, join_checked, text_of
from gridledger.llm.wordhash import BYTES, hash_of_bytes, mix, separators, word_hashes
from gridledger.session import materialize

# Expressions of a word: its first bytes, A-Z lower-cased, and the whole word.
# Words are cut at ASCII characters other than letters and digits.
HEADS = (4, 6, 8, None)
# So many log ratios at most are sent to the workers, those of the expressions in most documents; others are joined.
HELD = 1_000_000
# Contexts of an expression are counted in so many parts, so no task has all of a common one's.
SLICES = 16
DISCOUNT = 0.5
# A log ratio counts as far as it exceeds so many standard errors of chance.
ERRORS = 3.0
# Documents that set the scale of the score; a fold that the counts do not use.
CALIBRATION = 20_000
_ENDS = separators(bytes(b for b in range(128) if not chr(b).isalnum()))
_KINDS = mix(np.arange(1, len(HEADS) + 1, dtype=np.uint64))[:, None]


@dataclass
class Model:
    """Expressions (sorted hashes) with their log ratios, and the weights of the score; others have ratio 0.

    ``rest`` has the expressions beyond those that workers hold: ``word, ratio``.
    """

    hashes: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    rest: DataFrame | None = None

    def ratio(self, words: np.ndarray) -> np.ndarray:
        """Mean log ratio over the kinds of expressions of each word."""
        if not len(self.hashes):
            return np.zeros(words.shape[1])
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ratios[at], 0.0).mean(axis=0)


def _expressions(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at, words, places in word_hashes(texts, _ENDS, HEADS):
        yield at, words ^ _KINDS, places


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with a label that may be learned from: ``fold, toxic, text``. Of several labels the largest counts."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(~held_out())
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    return join_checked(rows, known, ["doc_id"], "inner").select(
        "doc_id", fold.alias("fold"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")


def _reaching(first: np.ndarray) -> list[np.ndarray]:
    """For each kind, whether a word is long enough to have an expression other than itself."""
    return [(first >> np.uint64(64 - 8 * h)) & np.uint64(255) > 0 for h in HEADS[:-1]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of texts and expression: documents of each class.

    A word that is shorter than a head is its own head, and no other word has
    that one. It gives one row for all such kinds; ``mask`` has a bit for each
    kind that a row stands for.
    """
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        for at, words, places in word_hashes(batch.column(1), _ENDS, (*HEADS, BYTES)):
            if not words.shape[1]:
                continue
            docs = np.repeat(np.arange(len(places) - 1), np.diff(places))
            reaching = _reaching(words[-1])
            whole = sum(((~r).astype(np.int64) << k for k, r in enumerate(reaching)), np.int64(1 << len(reaching)))
            for kind, own_kind in enumerate(_KINDS):
                used = reaching[kind] if kind < len(reaching) else slice(None)
                hashes, doc = words[kind, used] ^ own_kind, docs[used]
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")
                found, own = hashes[order], doc[order]
                first = np.append(True, found[1:] != found[:-1])
                starts = np.flatnonzero(first)
                new = first | np.append(True, own[1:] != own[:-1])
                label = toxic[at + own] > 0
                mask = np.full(len(starts), 1 << kind, np.int64) if kind < len(reaching) else whole[order[starts]]
                columns = [
                    found[starts].view(np.int64), np.full(len(starts), kind, np.int64),
                    np.add.reduceat((new & ~label).astype(np.int64), starts),
                    np.add.reduceat((new & label).astype(np.int64), starts), mask]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "kind", "ordinary", "toxic", "mask"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of texts the different pairs of a word and the word before it.

    A word is its first four bytes, the next four, and if it has all eight the
    hash of the whole, so the pairs of its heads follow from its own.
    """
    for batch in batches:
        for _, words, places in word_hashes(batch.column(0), _ENDS, (*HEADS, BYTES)):
            inner = np.ones(words.shape[1], bool)
            inner[places[:-1][places[:-1] < len(inner)]] = False
            at = np.flatnonzero(inner)
            whole, before, first = words[-2, at], words[-2, at - 1], words[-1, at]
            order = np.lexsort((before, whole))
            whole, before, first = whole[order], before[order], first[order]
            new = np.ones(len(order), bool)
            new[1:] = (whole[1:] != whole[:-1]) | (before[1:] != before[:-1])
            whole, before, first = whole[new], before[new], first[new]
            columns = [
                (first >> np.uint64(32)).astype(np.uint32).view(np.int32), first.astype(np.uint32).view(np.int32),
                np.where(first & np.uint64(255), whole, np.uint64(0)).view(np.int64),
                (before % np.uint64(SLICES)).astype(np.int8), before.view(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["head", "next", "whole", "slice", "before"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted contexts under the hashes of their expressions."""
    for batch in batches:
        kind = batch.column(0).to_numpy()
        first = batch.column(1).to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32)
        first = first | batch.column(2).to_numpy().view(np.uint32)
        whole = batch.column(3).to_numpy().view(np.uint64)
        word = np.where(whole != 0, whole, hash_of_bytes(first, 8)) ^ _KINDS[kind, 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(kind.astype(np.int64)), batch.column(4)], ["word", "kind", "contexts"])


def _contexts(train: DataFrame) -> DataFrame:
    """How many different words stand before an expression: ``word, kind, contexts``, up to ``SLICES`` rows each.

    All pairs with words of one beginning and slice meet in one task, so
    those of the heads need no exchange of their own.
    """
    pairs = train.select("text").mapInArrow(_followed, "head int, next int, whole long, slice byte, before long")
    none = F.lit(0).cast("long")
    of = lambda kind, following, whole: F.struct(
        F.lit(kind).alias("kind"), following.alias("following"), whole.alias("whole"))
    has = lambda column, byte: F.col(column).bitwiseAND(F.lit(byte)) != 0
    kinds = F.array_compact(F.array(
        F.when(has("head", 0xFF), of(0, F.lit(0), none)),
        F.when(has("next", 0xFF0000), of(1, F.col("next").bitwiseAND(F.lit(-0x10000)), none)),
        F.when(has("next", 0xFF), of(2, F.col("next"), none)),
        of(3, F.col("next"), F.col("whole"))))
    keys = ["head", "slice", "kind", "following", "whole"]
    each = pairs.repartition("head", "slice").select("head", "slice", "before", F.explode(kinds).alias("_of")).select(
        "head", "slice", "_of.*", "before").distinct()
    return each.groupBy(*keys).agg(F.count("*").alias("contexts")).select(
        "kind", "head", "following", "whole", "contexts").mapInArrow(_named, "word long, kind long, contexts long")


def _counts(train: DataFrame) -> DataFrame:
    """All expressions: ``word, kind, ordinary, toxic`` (documents of each class), ``contexts`` (different words before), ``mask``."""
    found = train.select("toxic", "text").mapInArrow(
        _counted, "word long, kind long, ordinary long, toxic long, mask long")
    rows = found.unionByName(_contexts(train), allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return materialize(rows.groupBy("word", "kind").agg(
        total("ordinary"), total("toxic"), total("contexts"), F.max("mask").alias("mask")), "expressions")


def log_ratios(
    ordinary: np.ndarray, toxic: np.ndarray, contexts: np.ndarray, documents: tuple[int, int],
    discount: float = DISCOUNT, errors: float = ERRORS, sums: tuple | None = None,
) -> np.ndarray:
    """log P(expression | toxic) - log P(expression | ordinary) of the expressions of one kind.

    Interpolated Kneser-Ney: a class keeps its document counts less the
    discount; what both discounts took is given out by the share of different
    contexts, the same in both classes. So an expression that one class lacks
    has there its shared, never a zero probability. Of a ratio, what chance
    explains is taken off: ``errors`` standard errors, so rare expressions
    fall back to no difference at all. ``sums`` has, over all expressions of
    the kind, the contexts plus one and what the discounts took; without it
    the given expressions are all.
    """
    contexts_of_all, discounts = sums or (
        (contexts + 1).sum(), np.minimum(ordinary, discount).sum() + np.minimum(toxic, discount).sum())
    shared = (contexts + 1) / contexts_of_all
    taken = discounts / sum(documents)
    logs = [np.log(np.maximum(n - discount, 0) / d + taken * shared) for n, d in zip((ordinary, toxic), documents)]
    ratio = logs[1] - logs[0]
    chance = errors * np.sqrt(1 / (ordinary + 0.5) + 1 / (toxic + 0.5))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - chance, 0)


def _ratios(counts: DataFrame, documents: tuple[int, int]) -> DataFrame:
    """The expressions whose log ratio is not 0: ``word, ratio, n`` (documents). Shares and discounts are of all."""
    least = [F.least(F.col(c).cast("double"), F.lit(DISCOUNT)) for c in ("ordinary", "toxic")]
    stands = [F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 for k in range(len(HEADS))]
    row = counts.agg(*[
        F.coalesce(F.sum(F.when(s, value)), F.lit(0)).cast("double").alias(f"{name}{k}")
        for name, value in (("shares", F.col("contexts") + 1), ("taken", least[0] + least[1])) for k, s in enumerate(stands)]).first()
    sums = np.array(row).reshape(2, len(HEADS))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, kinds, ordinary, toxic, contexts, mask = (c.to_numpy() for c in batch.columns)
            for kind in range(len(HEADS)):
                own = (mask >> kind) & 1 > 0
                o, t, c = (x[own].astype(float) for x in (ordinary, toxic, contexts))
                # A word that is its own head is known there by that kind's hash.
                names = word[own].view(np.uint64) ^ _KINDS[kinds[own], 0] ^ _KINDS[kind, 0]
                found = log_ratios(o, t, c, documents, sums=tuple(sums[:, kind]))
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, [names.view(np.int64), found, (o + t).astype(np.int64)])), ["word", "ratio", "n"])

    return materialize(counts.mapInArrow(rated, "word long, ratio double, n long").filter("ratio <> 0"), "ratios")


def _split(ratios: DataFrame, held: int) -> tuple[DataFrame, DataFrame | None]:
    """What workers hold and what is joined, if anything: a count of counts gives the least number of documents of the held."""
    if ratios.count() <= held:
        return ratios, None
    step = F.floor(F.log2("n") * 8).cast("int")
    taken, least = 0, None
    for here, n in sorted(ratios.groupBy(step).count().collect(), reverse=True):
        if taken + n > held:
            break
        taken, least = taken + n, here
    common = F.lit(False) if least is None else step >= least
    return ratios.filter(common), ratios.filter(~common).select("word", "ratio")


def _with_joined(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``more``, the sum of the log ratios in ``text`` that workers do not hold.

    Each different text sends each of its other expressions once. The sum
    follows from the text alone, so it comes back by the text's hashes.
    """
    if model.rest is None:
        return rows.withColumn("more", F.lit(0.0))
    held = rows.sparkSession.sparkContext.broadcast(model.hashes)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, places in _expressions(batch.column(2)):
                for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
                    found, n = np.unique(words[:, a:b], return_counts=True)
                    other = ~np.isin(found, held.value)
                    keys = [np.full(other.sum(), batch.column(k)[at + i].as_py()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        list(map(pa.array, [*keys, found[other].view(np.int64), n[other].astype(np.int64)])),
                        ["_a", "_b", "word", "times"])

    keyed = rows.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text")})
    sent = keyed.select("_a", "_b", "text").mapInArrow(others, "_a long, _b long, word long, times long").distinct()
    sums = sent.join(model.rest, "word").groupBy("_a", "_b").agg(
        (F.sum(F.col("times") * F.col("ratio")) / len(HEADS)).alias("more"))
    found = split_join(keyed, sums, ["_a", "_b"], [c for c in rows.columns if c != "text"], "left")
    return found.select(*rows.columns, F.coalesce("more", F.lit(0.0)).alias("more"))


def _scored(model: Model, texts: pa.Array, more: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, mean log ratio per word (0 without any), number of words."""
    joined = more.to_numpy()
    for at, words, places in _expressions(texts):
        sums = np.concatenate([[0.0], np.cumsum(model.ratio(words))])
        n = np.diff(places)
        yield at, (sums[places[1:]] - sums[places[:-1]] + joined[at:at + len(n)]) / np.maximum(n, 1), n


def _features(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The normalised ratio counts for more in a longer text, where chance evens out."""
    return np.stack([np.ones(len(mean)), mean, mean * np.log1p(n), 1 / np.sqrt(n + 1.0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
    return w


def _calibrated(model: Model, rows: DataFrame, size: int) -> np.ndarray:
    """Weights of the score from at most ``size`` documents or so, drawn by id, of the fold that was not counted."""
    given = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    share = size / max(rows.count(), size)
    drawn = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, mean, n in _scored(given.value, batch.column(1), batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(mean), pa.array(n.astype(np.int64))], ["toxic", "mean", "n"])

    points = _with_joined(drawn.select("toxic", "text"), model).mapInArrow(measured, "toxic int, mean double, n long").toPandas()
    if points["toxic"].nunique() < 2:
        return np.array([-2.0, 10.0, 0.0, 0.0])
    points = points.sort_values(["mean", "n", "toxic"])
    return _logistic(_features(points["mean"].to_numpy(), points["n"].to_numpy(float)), points["toxic"].to_numpy(float))


def fit(docs: DataFrame, labels: DataFrame, calibration: int = CALIBRATION) -> Model:
    """Counts of all expressions over all labelled documents of three folds, the scale from the fourth; held-out rows are not read."""
    rows = _labelled(docs, labels)
    train = rows.filter("fold < 4")
    classes = dict(train.groupBy("toxic").count().collect())
    held, rest = _split(_ratios(_counts(train), (classes.get(0, 1), classes.get(1, 1))), HELD)
    found = held.select("word", "ratio").toPandas()
    hashes = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], found["ratio"].to_numpy(float)[order], np.zeros(4), rest)
    model.weights = _calibrated(model, rows.filter("fold = 4"), calibration)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Score of every whole text: ``doc_id, held_out, score, predicted, log_ratio``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and
    ``toxic``; other columns are not read, and no label of a held-out document
    is. ``log_ratio`` is the mean over the words of a text, so length
    does not add up; ``score`` maps it to 0 to 1 by a logistic curve. A null
    or empty text has ratio 0 and the score of that. Without labels of both
    classes a fixed curve is used. Each row gives one row.
    """
    model = model or fit(docs, labels)
    given = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, mean, n in _scored(given.value, batch.column(2), batch.column(3)):
                score = 1 / (1 + np.exp(-np.clip(_features(mean, n) @ given.value.weights, -30, 30)))
                part = batch.slice(at, len(n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(mean)],
                    ["doc_id", "held_out", "score", "predicted", "log_ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return _with_joined(rows, model).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, log_ratio double")
