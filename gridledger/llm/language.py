"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import given_back, held_out, join_checked, text_of

UNKNOWN = "und"
# Runs of three characters, hashed into this many features.
BITS = 12
FEATURES = 1 << BITS
# About so many labelled documents of each language, drawn by id, are clustered. The bound of the fit.
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 12
# A text is rejected below this part of the median cosine of its language's texts of its length,
# measured on every fourth text of the sample, which the centroids do not use.
REJECT = 0.3
ASIDE = 4
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
# Texts are turned into features in groups of so many rows, and in pieces of so many characters.
GROUP = 64
PIECE = 1 << 20


@dataclass
class Model:
    """Languages, unit centroids and the language of each, weights of features, usual cosine by language and length."""

    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    usual: np.ndarray


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    return table


def _features(text: str) -> np.ndarray:
    """The feature of every run of three characters.

    Text is lower-cased; characters between letters count as one space, as do
    both ends. A long text is read in pieces that overlap by two characters.
    """
    table, found, last = _letters(), [], np.array([32, 32], np.uint32)
    for at in range(0, len(text) + 1, PIECE):
        piece = text[at:at + PIECE]
        codes = np.frombuffer(piece.lower().encode("utf-32-le"), "<u4")
        codes = np.where(table[codes], codes, 32).astype(np.uint32)
        if at + PIECE > len(text):
            codes = np.append(codes, np.uint32(32))
        codes = np.concatenate([last, codes])
        keep = np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))
        codes = codes[keep].astype(np.uint64)
        last = codes[-2:].astype(np.uint32) if len(codes) > 1 else np.append(np.uint32(32), codes.astype(np.uint32))
        mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
                 ^ codes[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found)


def _counts(texts: list[str]) -> np.ndarray:
    """Features of each text, counted."""
    found = [_features(t) for t in texts]
    rows = np.repeat(np.arange(len(texts)) * FEATURES, [len(f) for f in found])
    return np.bincount(rows + np.concatenate(found), minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors with damped counts."""
    vectors = np.log1p(counts).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _learnable(docs: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold: ``doc_id, lang, text``."""
    return docs.select("doc_id", "lang", text_of().alias("text")).filter(F.col("lang").isNotNull() & ~held_out())


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            texts = batch.column(0).slice(at, GROUP).to_pylist()
            total += (_counts(texts) > 0).sum(axis=0)
            rows += len(texts)
    # The last place counts the documents.
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, rows))], ["feature", "n"])


def _idf(train: DataFrame) -> np.ndarray:
    """Inverse document frequency of each feature over all labelled documents."""
    sums = train.select("text").mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(
        F.sum("n").alias("n")).toPandas()
    n = np.zeros(FEATURES + 1)
    n[sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are the mean and then the vectors farthest from those before."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(k, len(vectors)):
        near = np.max(vectors @ np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centres]).T, axis=1)
        centres.append(vectors[np.argmin(near)])
    centres = np.stack(centres)
    for _ in range(ROUNDS):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        nearest = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([vectors[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Weights from all labelled documents, centroids from about ``sample`` documents of each language."""
    train = _learnable(docs)
    sizes = train.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    drawn = join_checked(train, sizes, ["lang"], "inner").filter(place < share).select("doc_id", "lang", "text")
    idf = _idf(train)
    weights = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"])
        texts = part["text"].tolist()
        # Few texts have to do for both.
        few = len(texts) < 2 * ASIDE
        own = [t for i, t in enumerate(texts) if few or i % ASIDE]
        aside = texts if few else texts[::ASIDE]
        vectors = np.concatenate([_unit(_counts(own[i:i + GROUP]), weights.value) for i in range(0, len(own), GROUP)])
        centres = _clustered(vectors, centroids)
        # The median cosine of the texts cut to each length; of lengths that no text has, that of the one before.
        usual = [0.0]
        for length in LENGTHS:
            cut = [t[:length] for t in aside if len(t) >= length]
            near = [(_unit(_counts(cut[i:i + GROUP]), weights.value) @ centres.T).max(axis=1) for i in range(0, len(cut), GROUP)]
            usual.append(float(np.median(np.concatenate(near))) if cut else usual[-1])
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [c.tolist() for c in centres], "usual": [usual[1:]] * len(centres)})

    rows = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, usual array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.lang)
    languages = sorted({r.lang for r in rows})
    return Model(
        languages, np.array([r.centre for r in rows], np.float32), np.array([languages.index(r.lang) for r in rows]), idf,
        np.array([next(r.usual for r in rows if r.lang == name) for name in languages]))


def _predict(model: Model | None, texts: list[str]) -> list[tuple[str, float, bool]]:
    """Language, cosine and whether the text is rejected."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    table = _letters()
    some = [i for i, t in enumerate(texts) if t and table[np.frombuffer(t.encode("utf-32-le"), "<u4")].any()]
    if model is None or not some:
        return out
    near = _unit(_counts([texts[i] for i in some]), model.idf) @ model.centroids.T
    best = near.argmax(axis=1)
    for row, i in enumerate(some):
        cosine = float(np.clip(near[row, best[row]], 0, 1))
        place = np.searchsorted(LENGTHS, len(texts[i]), "right") - 1
        language = model.owner[best[row]]
        limit = REJECT * model.usual[language, place] if place >= 0 else 0.0
        out[i] = (model.languages[language], cosine, bool(cosine < limit))
    return out


def _found(batches: Iterator[pa.RecordBatch], text_at: int, model: Model | None) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Parts of the batches with language, cosine and rejection of each row."""
    for batch in given_back(batches):
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            found = _predict(model, [t or "" for t in part.column(text_at).to_pylist()])
            added = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield part, added


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, rejected``.

    ``docs`` needs ``doc_id, text, lang``; other columns are not read, and
    ``lang`` is used only to learn, from rows outside the held-out fold. The
    prediction is the language of the nearest centroid by cosine, the first
    in code point order of equals, and ``score`` is that cosine. A text without any
    letter, or null, is ``und`` with score 0. ``rejected`` marks those and
    texts much farther from the nearest centroid than its language's texts of
    their length usually are; texts below 8 characters are not. Without labelled rows all texts are ``und``. Each row gives one row.
    """
    given = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, added in _found(batches, 2, given.value):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *added], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def without_rejected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not rejected."""
    given = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    text_at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, added in _found(batches, text_at, given.value):
            yield part.filter(pc.invert(added[2]))

    return docs.mapInArrow(kept, docs.schema)
