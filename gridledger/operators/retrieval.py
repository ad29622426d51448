"""Contract-scoped similarity search over whole tables of events."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gridledger import fixed_values as fv
from gridledger.functions.scalars import col_of, fact_text, fill_template, share
from gridledger.functions.skew import lookup_join, split_join
from gridledger.session import materialize

# Similarities are compared at this precision, so that ties do not depend on
# the order in which a product was summed.
_DIGITS = 9
_NO_VALUE = -2.0
_SLICE = 512
# Chunks that are clustered and searched at once; chunks that a task goes through, as a multiple of the events it holds.
_SEARCHED = 8192
_STRIPE = 8
# Vectors a cluster holds on average; what a bound may be off by, as angles near zero are inexact.
CLUSTER = 128
_TOLERANCE = 1e-7
HASH_DIMENSIONS = 64
# White space between the tokens of the hashing embedder.
TOKEN_SPACE = r"[\t-\r ]+"


def retrieval_query(events: DataFrame) -> DataFrame:
    """Adds ``query_text``, the search text of a breach event."""
    event_type = F.col("event_type") if "event_type" in events.columns else F.lit(None).cast("string")
    text = fill_template(fv.RETRIEVAL_QUERY, {
        "event_type": F.coalesce(event_type, F.lit(fv.DEFAULT_EVENT_TYPE)),
        "contract_id": fact_text("contract_id"),
        "asset_id": fact_text("asset_id"),
        "iso_region": fact_text("iso_region"),
        "leakage": fact_text("estimated_leakage_revenue_usd", "double"),
    })
    return events.withColumn("query_text", text)


def feature_hash(text: Column | str, dimensions: int = HASH_DIMENSIONS) -> Column:
    """A repeatable bag-of-words vector: signed token hashes, unit length.

    The first eight hexadecimal digits of a token's MD5 choose its place, the
    ninth its sign. A null text counts as empty; without tokens all is zero.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(col_of(text), F.lit(""))), TOKEN_SPACE), lambda t: t != "")
    return _signed_sums(dimensions)(F.transform(tokens, lambda t: t.cast("binary")))


def _code(token: bytes, dimensions: int) -> int:
    digest = hashlib.md5(token).hexdigest()
    place = int(digest[:8], 16) % dimensions + 1
    return place if digest[8] >= "8" else -place


def _signed_sums(dimensions: int) -> Callable[[Column], Column]:
    """Arrays of tokens to vectors of unit length: every token is looked at once, every different one of a batch hashed once."""

    @F.arrow_udf("array<float>")
    def sums(tokens: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        coded = tokens.flatten().dictionary_encode()
        codes = np.array([_code(token, dimensions) for token in coded.dictionary.to_pylist()], np.int64)
        signed = codes[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(rows * dimensions + np.abs(signed) - 1, np.sign(signed), len(tokens) * dimensions).reshape(len(tokens), dimensions)
        unit, _ = _unit(counts)
        offsets = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dimensions)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.astype(np.float32).ravel()))

    return sums


def embed(df: DataFrame, text: str, vector: str, embedder=None, batch: int = fv.EMBED_BATCH) -> DataFrame:
    """Adds a vector column: ``feature_hash``, or what ``embedder`` maps a list of texts to, in batches."""
    if embedder is None:
        return df.withColumn(vector, feature_hash(text))
    schema = T.StructType(df.schema.fields + [T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(batches):
        for table in batches:
            texts = table.column(table.schema.get_field_index(text)).to_pylist()
            vectors = []
            for start in range(0, len(texts), batch):
                vectors.extend(embedder(texts[start:start + batch]))
            columns = [*table.columns, pa.array(vectors, type=pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*table.schema.names, vector])

    return df.mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """Vectors as rows; a null vector counts as zero, vectors of another length than ``size`` are an error."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    known = lengths >= 0
    size = size or int(lengths.max(initial=-1))
    if (lengths[known] != size).any():
        raise ValueError(f"vectors of {sorted(set(lengths[known].tolist()))} numbers where {size} are asked for")
    out = np.zeros((len(column), max(size, 1)))
    out[known] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(known.sum(), -1))
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(m, axis=1)
    return m / np.where(norms > 0, norms, 1.0)[:, None], norms > 0


def _clusters(unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of each row, centre of each cluster and its greatest angle to a row.

    The first pivot is the first row, each further one the row that is least
    like all before; rows go to the pivot most like them.
    """
    place, near = np.zeros(len(unit), np.int64), unit @ unit[0]
    for cluster in range(1, -(-len(unit) // size)):
        like = unit @ unit[np.argmin(near)]
        closer = like > near
        place[closer], near[closer] = cluster, like[closer]
    _, place = np.unique(place, return_inverse=True)
    centres = np.zeros((place.max() + 1, unit.shape[1]))
    np.add.at(centres, place, unit)
    centres, _ = _unit(centres)
    angles = np.arccos(np.clip((unit * centres[place]).sum(axis=1), -1.0, 1.0))
    radius = np.zeros(len(centres))
    np.maximum.at(radius, place, angles)
    return place, centres, radius


def search(
    queries: np.ndarray, vectors: np.ndarray, k: int, wanted: np.ndarray, have: np.ndarray, size: int = CLUSTER,
    floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and rounded cosine of the k best vectors of each query, and how many vectors each was compared with.

    ``wanted`` and ``have`` are versions as numbers, -1 wants any. Ties go to
    the lower place; where a vector is zero the cosine is ``_NO_VALUE``.
    Vectors are clustered; a cosine can be no greater than that of the angle
    to the centre less the radius, so a cluster whose bound lies below a
    query's k-th best so far is skipped for that query. The result is that
    of comparing all. ``floor`` has the k cosines, ascending, that each query
    has found elsewhere; only places with a greater one than the least are
    returned then.
    """
    (queries, asked), (vectors, known) = _unit(queries), _unit(vectors)
    zero, full = np.flatnonzero(~known), np.flatnonzero(known)
    members, centres, radius = [], np.zeros((0, vectors.shape[1])), np.zeros(0)
    if len(full):
        place, centres, radius = _clusters(vectors[full], size)
        order = np.argsort(place, kind="stable")
        members = np.split(full[order], np.flatnonzero(np.diff(place[order])) + 1)
    if len(zero):
        members.append(zero)
    found, compared = [], np.zeros(len(queries), np.int64)
    # A slice of queries at a time bounds the score matrix.
    for start in range(0, len(queries), _SLICE):
        part = np.arange(start, min(start + _SLICE, len(queries)))
        angle = np.arccos(np.clip(queries[part] @ centres.T, -1.0, 1.0)) - radius
        bound = np.where(asked[part, None], np.cos(np.maximum(angle, 0.0)) + _TOLERANCE, np.inf)
        if len(zero):
            bound = np.hstack([bound, np.where(asked[part, None], _NO_VALUE, np.inf)])
        # Rounded cosines differ by more than is added, so an equal one comes too late.
        best = np.full((len(part), k), -np.inf) if floor is None else floor[part] + 0.5 * 10.0 ** -_DIGITS
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cluster in np.argsort(-bound.max(axis=0), kind="stable"):
            rows = np.flatnonzero(bound[:, cluster] >= best[:, 0])
            if not len(rows):
                continue
            columns = members[cluster]
            score = queries[part[rows]] @ vectors[columns].T
            if not asked[part[rows]].all():
                score[~asked[part[rows]], :] = _NO_VALUE
            if not known[columns].all():
                score[:, ~known[columns]] = _NO_VALUE
            if (wanted[part[rows]] >= 0).any():
                score[(wanted[part[rows], None] >= 0) & (wanted[part[rows], None] != have[None, columns])] = -np.inf
            compared[part[rows]] += len(columns)
            # Only scores that may still be among the k best; best[:, 0] is the k-th. Few are left to be rounded.
            some = np.flatnonzero(score.max(axis=1) >= best[rows, 0] - 10.0 ** -_DIGITS)
            score = np.round(score[some], _DIGITS)
            good = (score >= best[rows[some], :1]) & np.isfinite(score)
            kept = good.any(axis=1)
            some, score, good = some[kept], score[kept], good[kept]
            if not len(some):
                continue
            row, column = np.nonzero(good)
            hits.append((part[rows[some[row]]], columns[column], score[row, column]))
            both = np.hstack([best[rows[some]], score])
            best[rows[some]] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        if hits:
            row, column, value = (np.concatenate(x) for x in zip(*hits))
            late = value >= best[row - start, 0]
            row, column, value = row[late], column[late], value[late]
            order = np.lexsort((column, -value, row))
            row, column, value = row[order], column[order], value[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            found.append((row[keep], column[keep], value[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), compared
    row, column, value = (np.concatenate(x) for x in zip(*found))
    return row, column, value, compared


_KEY = ["contract_id", "document_version_hash", "chunk_index"]
_DETAILS = ["document_version_hash", "chunk_index", "chunk_id"]
_FOUND = pa.schema([
    ("event_id", pa.string()), ("contract_id", pa.string()), ("document_version_hash", pa.string()), ("chunk_index", pa.int64()),
    ("chunk_id", pa.int64()), ("similarity", pa.float64()), ("compared", pa.int64()), ("held", pa.int64())])


def _dimensions(column: pa.ChunkedArray) -> int | None:
    return pc.max(pc.list_value_length(column)).as_py()


class _Block:
    """The best k chunks so far of each event of a block; chunks come by index and version, so ties stay with those that are there."""

    def __init__(self, events: pa.Table, k: int):
        self.events, self.k, self.held = events.select(["event_id", "contract_id"]), k, 0
        self.size = _dimensions(events.column("vector"))
        self.queries = None if self.size is None else _matrix(events.column("vector"), self.size)
        self.versions: dict = {}
        self.wanted = np.array([-1 if v is None else self._number(v) for v in events.column("document_version_hash").to_pylist()], np.int64)
        # Equal questions are asked once.
        asked = np.zeros((len(self.wanted), 0)) if self.queries is None else self.queries
        _, first, self.question = np.unique(np.hstack([self.wanted[:, None], asked]), axis=0, return_index=True, return_inverse=True)
        self.question, self.wanted = self.question.reshape(-1), self.wanted[first]
        self.queries = None if self.queries is None else self.queries[first]
        # Descending; where a chunk's details lie in ``details``.
        self.value, self.place = np.full((len(self.wanted), k), -np.inf), np.full((len(self.wanted), k), -1, np.int64)
        self.compared, self.details, self.kept = np.zeros(len(self.wanted), np.int64), [], 0

    def _number(self, version: str) -> int:
        return self.versions.setdefault(version, len(self.versions))

    def add(self, chunks: pa.Table) -> None:
        if self.size is None:
            self.size = _dimensions(chunks.column("vector"))
        vectors = _matrix(chunks.column("vector"), self.size)
        # Events without any vector are zero, of whatever length.
        queries = np.zeros((len(self.wanted), vectors.shape[1])) if self.queries is None else self.queries
        have = np.array([self.versions.get(v, -2) for v in chunks.column("document_version_hash").to_pylist()], np.int64)
        row, column, value, compared = search(queries, vectors, self.k, self.wanted, have, floor=self.value[:, ::-1])
        self.compared += compared
        self.held += len(vectors)
        if not len(row):
            return
        used, slot = np.unique(column, return_inverse=True)
        self.details.append(chunks.select(_DETAILS).take(pa.array(used)))
        rows, first, count = np.unique(row, return_index=True, return_counts=True)
        new, place = np.full((len(rows), self.k), -np.inf), np.full((len(rows), self.k), -1, np.int64)
        at = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(first, count)
        new[at], place[at] = value, slot + self.kept
        self.kept += len(used)
        new, place = np.hstack([self.value[rows], new]), np.hstack([self.place[rows], place])
        order = np.argsort(-new, axis=1, kind="stable")[:, :self.k]
        self.value[rows], self.place[rows] = np.take_along_axis(new, order, 1), np.take_along_axis(place, order, 1)

    def found(self) -> pa.Table:
        row, rank = np.nonzero(self.place[self.question] >= 0)
        if not len(row):
            return _FOUND.empty_table()
        question = self.question[row]
        value = self.value[question, rank]
        details = pa.concat_tables(self.details).take(pa.array(self.place[question, rank]))
        return pa.table([
            self.events.column("event_id").take(pa.array(row)), self.events.column("contract_id").take(pa.array(row)),
            *[details.column(c) for c in _DETAILS], pa.array(value, type=pa.float64(), mask=value == _NO_VALUE),
            pa.array(self.compared[question]), pa.array(np.full(len(row), self.held, np.int64)),
        ], schema=_FOUND)


def _block_top_k(k: int, chunk_rows: int = _SEARCHED):
    """For the rows of a block, events first and then chunks by index and version; only events and what they found are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events, block, waiting, rows = [], None, [], 0
        for batch in batches:
            chunks = batch.filter(batch.column("is_chunk"))
            if chunks.num_rows < batch.num_rows:
                if block or waiting:
                    raise ValueError("events come before the chunks of their block")
                events.append(batch.filter(pc.invert(batch.column("is_chunk"))))
            if chunks.num_rows and events:
                waiting.append(chunks)
                rows += chunks.num_rows
            if rows >= chunk_rows:
                block = block or _Block(pa.Table.from_batches(events), k)
                block.add(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if waiting:
            block = block or _Block(pa.Table.from_batches(events), k)
            block.add(pa.Table.from_batches(waiting))
        if block:
            yield from block.found().to_batches()

    return run


def retrieve(
    events: DataFrame, chunks: DataFrame, k: int = fv.RETRIEVAL_TOP_K, clause: str | None = None, block: int = 65536,
    effort: bool = False,
) -> DataFrame:
    """The k most similar chunks of its own contract for each event.

    ``events``: event_id (text), contract_id, document_version_hash (null for
    any version), query_vector. ``chunks``: chunk_id, contract_id,
    document_version_hash, chunk_index, clause_type, embedding_vector; a chunk
    is known by contract, version and index. Both should be stored tables:
    contracts are counted before vectors are read. Ties go to the lower index,
    then the lower version. With ``effort`` each row also tells how many of the
    ``held`` vectors of its block its event was ``compared`` with.

    The events of a contract are cut into blocks of at most about ``block``
    rows and its chunks into stripes of at most eight times as many. A task
    holds the events of a block and goes through the chunks of a stripe, some
    thousands at a time. These are clustered, and an event skips the clusters
    that cannot hold one of its k best; pairs never become rows, and the result
    is exact. A contract with a large share of the data is many independent
    pairs. A chunk is sent once per block of events, and an event and what it
    found once per stripe: a side that is small beside the other is cut finer,
    and a larger ``block`` shuffles less and takes more memory per task.
    """
    pool = chunks if clause is None else chunks.filter(F.col("clause_type") == clause)
    pool = pool.select(
        "chunk_id", "contract_id", "document_version_hash", F.col("chunk_index").cast("long").alias("chunk_index"), "embedding_vector")
    asked = events.select("event_id", "contract_id", "document_version_hash", "query_vector")
    # Vectors of contracts nobody asks about are not moved.
    wanted = asked.select("contract_id").distinct()
    pool = lookup_join(pool, wanted, ["contract_id"], ["document_version_hash", "chunk_index"], "left_semi")

    # Contracts that need more than one block, counted once; at most the rows of both sides / 8,192.
    events_of, chunks_of = F.col("_events"), F.col("_chunks")
    sizes = asked.groupBy("contract_id").agg(F.count("*").alias("_events")).join(
        pool.groupBy("contract_id").agg(F.count("*").alias("_chunks")), "contract_id")
    large = materialize(sizes.select(
        "contract_id",
        F.ceil(events_of / F.least(F.greatest(chunks_of, F.lit(_SEARCHED)), F.lit(block))).cast("int").alias("event_blocks"),
        F.ceil(chunks_of / F.least(F.greatest(events_of * _STRIPE, F.lit(_SEARCHED)), F.lit(block * _STRIPE))).cast("int").alias("chunk_blocks"),
    ).filter((F.col("event_blocks") > 1) | (F.col("chunk_blocks") > 1)), "large-contracts")

    def place(df: DataFrame, by: list[str], own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        here, there = F.coalesce(own_blocks, F.lit(1)), F.coalesce(other_blocks, F.lit(1))
        return (
            lookup_join(df, large, ["contract_id"], by)
            .withColumn(own, F.pmod(F.xxhash64(*by), here).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), there - 1)))
            .drop("event_blocks", "chunk_blocks")
        )

    keys = ["contract_id", "event_block", "chunk_block"]
    left = place(asked, ["event_id"], "event_block", "event_blocks", "chunk_block", "chunk_blocks")
    right = place(pool, ["document_version_hash", "chunk_index"], "chunk_block", "chunk_blocks", "event_block", "event_blocks")
    none = F.lit(None)
    left = left.select(
        *keys, "document_version_hash", F.lit(False).alias("is_chunk"), none.cast("long").alias("chunk_index"), "event_id",
        none.cast("long").alias("chunk_id"), F.col("query_vector").alias("vector"))
    right = right.select(
        *keys, "document_version_hash", F.lit(True).alias("is_chunk"), "chunk_index", none.cast("string").alias("event_id"),
        F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding_vector").alias("vector"))
    rows = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "is_chunk", "chunk_index", "document_version_hash")
    found = rows.groupBy(*keys).applyInArrow(
        _block_top_k(k), "event_id string, contract_id string, document_version_hash string, chunk_index long, chunk_id long, "
        "similarity double, compared long, held long")
    order = W.partitionBy("event_id").orderBy(F.desc_nulls_last("similarity"), "chunk_index", "document_version_hash")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked if effort else ranked.drop("compared", "held")


def retrieve_context(
    events: DataFrame, chunks: DataFrame, k: int = fv.RETRIEVAL_TOP_K, clause: str | None = None
) -> DataFrame:
    """Retrieved chunks with their text and locator.

    Texts are joined to the result by contract, version and index, after the
    search; a chunk that a large share of the events retrieves is a skewed key
    of the left side, which adaptive execution splits.
    """
    details = chunks.drop("embedding_vector", "chunk_id").withColumnsRenamed({c: f"_{c}" for c in _KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "document_version_hash" else F.col(c) == F.col(f"_{c}") for c in _KEY]
    found = retrieve(events, chunks, k, clause).withColumn("chunk_index", F.col("chunk_index").cast(chunks.schema["chunk_index"].dataType))
    return found.join(details, reduce(and_, same)).drop(*[f"_{c}" for c in _KEY])


def evidence_array(found: DataFrame) -> DataFrame:
    """One row per event with its ranked chunks; at most k entries each."""
    entry = F.struct(
        "rank", "chunk_id", "contract_id", "page_number", "chunk_index", "section_heading",
        "clause_type", "text_snippet", "similarity",
    )
    return found.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))


def cache_key(clause: str | None = None, model: str = fv.EMBEDDING_MODEL) -> Column:
    """Key of a retrieval: everything its result depends on."""
    material = F.to_json(
        F.struct(
            F.lit(clause).cast("string").alias("clause_type"), "contract_id", "document_version_hash",
            F.lit(model).alias("embedding_model"), F.col("query_text").alias("query"),
            F.lit(fv.RETRIEVAL_VERSION).alias("retrieval_version"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.lit("rag:"), F.sha2(material, 256))


def cached_retrieve(
    events: DataFrame, chunks: DataFrame, cache: DataFrame, now: dt.datetime,
    k: int = fv.RETRIEVAL_TOP_K, clause: str | None = None, ttl_seconds: int = fv.CACHE_TTL_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """Evidence per event, from the cache where a fresh entry exists.

    Returns (event rows with evidence and ``cache_hit``, cache rows to append).
    ``cache`` has cache_key, cached_at and evidence. Equal misses are searched once.
    """
    keyed = events.withColumn("cache_key", cache_key(clause))
    fresh = cache.filter(F.col("cached_at") > F.lit(now - dt.timedelta(seconds=ttl_seconds)))
    newest = fresh.groupBy("cache_key").agg(F.max_by("evidence", "cached_at").alias("evidence"))
    known = split_join(keyed, newest.withColumn("cache_hit", F.lit(True)), ["cache_key"], ["event_id"], "left")
    # Written once: both answers below and the search read it.
    known = materialize(known.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False))), "cache-answers")
    missed = known.filter(~F.col("cache_hit")).drop("evidence")
    asked = missed.groupBy("cache_key").agg(
        F.first("contract_id").alias("contract_id"),
        F.first("document_version_hash").alias("document_version_hash"),
        F.first("query_vector").alias("query_vector"),
    ).withColumnRenamed("cache_key", "event_id")
    found = materialize(
        evidence_array(retrieve_context(asked, chunks, k, clause)).withColumnRenamed("event_id", "cache_key"), "cache-additions")
    searched = split_join(missed, found, ["cache_key"], ["event_id"], how="left")
    additions = found.withColumn("cached_at", F.lit(now)).select("cache_key", "cached_at", "evidence")
    return known.filter("cache_hit").unionByName(searched), additions


def retrieval_quality(events: DataFrame, found: DataFrame) -> DataFrame:
    """Chunk count, best and average similarity and flags per event; events without hits stay."""
    stats = found.groupBy("event_id").agg(
        F.count("*").alias("_n"),
        F.max("similarity").alias("top_similarity_score"),
        F.avg("similarity").alias("average_similarity_score"),
        F.collect_set(F.col("contract_id")).alias("_contracts"),
    )
    foreign = F.exists("_contracts", lambda c: c != F.col("contract_id"))
    return (
        events.select("event_id", "contract_id", "document_version_hash")
        .join(stats, "event_id", "left")
        .select(
            "event_id", "contract_id", "document_version_hash",
            F.coalesce("_n", F.lit(0)).alias("retrieved_chunk_count"),
            "top_similarity_score", "average_similarity_score",
            F.col("_n").isNull().alias("no_evidence_flag"),
            F.coalesce(foreign, F.lit(False)).alias("wrong_contract_blocked_flag"),
        )
    )


def evidence_prompt(evidence: Column) -> Column:
    """Labelled text of the evidence entries, divided by a rule."""
    fields = (
        ("CHUNK_ID", "chunk_id", "string"), ("CONTRACT_ID", "contract_id", "string"),
        ("PAGE", "page_number", "string"), ("SECTION", "section_heading", "string"),
        ("CLAUSE_TYPE", "clause_type", "string"), ("SIMILARITY", "similarity", "double"),
        ("TEXT", "text_snippet", "string"),
    )

    def block(e: Column) -> Column:
        return F.concat_ws("\n", *[F.concat(F.lit(label + ": "), fact_text(e[name], kind)) for label, name, kind in fields])

    return F.array_join(F.transform(evidence, block), "\n\n---\n\n")


def no_evidence_rate(quality: DataFrame) -> DataFrame:
    return quality.agg(share(F.count_if("no_evidence_flag"), F.count("*")).alias("no_evidence_rate"))
