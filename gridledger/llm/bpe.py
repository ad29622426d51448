"""Byte-level byte-pair encoding by ranked merges, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import given_back, text_of
from gridledger.llm.pretokens import finder

ROWS = 256
# Distinct words that a worker remembers; the memory is emptied beyond.
REMEMBERED = 250_000
# Longer words are folded by a heap, and not remembered.
LONG = 128
# Fixed value: public_tokenizers.PATTERN with {L}, {N}, {S} for its classes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Rank of each byte string of the vocabulary, which is also its id."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}


class ByteCodec:
    """Encodes words by folding ranked merges over their bytes; remembers distinct words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {n: word for word, n in ranks.items()}
        self.find = finder(WORDS)
        self.words: dict[str, bytes] = _Remembered(self)

    def fold(self, word: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, the first of equals, until no two neighbours are a known string."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > LONG:
            return self._fold_long(word)
        parts = [word[i:i + 1] for i in range(len(word))]
        worst = len(ranks)
        order = [ranks.get(a + b, worst) for a, b in zip(parts, parts[1:])]
        while order:
            best = min(order)
            if best == worst:
                break
            at = order.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at < len(order):
                order[at] = ranks.get(parts[at] + parts[at + 1], worst)
            if at:
                order[at - 1] = ranks.get(parts[at - 1] + parts[at], worst)
        return [ranks[p] for p in parts]

    def _fold_long(self, word: bytes) -> list[int]:
        """The same merges in the same order from a heap of pairs (rank, place) over linked parts: n log n steps.

        A part is known by where it begins; a pair in the heap is passed over
        when one of its parts has changed since.
        """
        ranks, n = self.ranks, len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(word[at:at + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            # Where a part was merged into the one before, ends is 0.
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[at], ends[middle] = end, 0
            before[end] = at
            if end < n and (rank := ranks.get(word[at:ends[end]])) is not None:
                heapq.heappush(heap, (rank, at, ends[end]))
            if at and (rank := ranks.get(word[before[at]:end])) is not None:
                heapq.heappush(heap, (rank, before[at], end))
        found, at = [], 0
        while at < n:
            found.append(ranks[word[at:ends[at]]])
            at = ends[at]
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Remembered(dict):
    def __init__(self, codec: ByteCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.codec.fold(word.encode()), "<u4").tobytes()
        if len(word) <= LONG:
            self[word] = found
        return found


_CODECS: dict[int, ByteCodec] = {}


def _codec(ranks: dict[bytes, int]) -> ByteCodec:
    """One codec per worker and vocabulary, so that words of earlier tasks are known."""
    name = hash(frozenset(ranks)) ^ len(ranks)
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = ByteCodec(ranks)
    return _CODECS[name]


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.
    Returns ``doc_id, n_tokens, ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256``; with ``with_ids`` also
    ``ids``. A null text counts as empty and has no tokens. Special strings
    are ordinary text. Each row gives one row.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in given_back(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts, ids, back, lists = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = codec.encode(text)
                    counts.append(len(found) // 4)
                    ids.append(hashlib.sha256(found).hexdigest())
                    back.append(hashlib.sha256(codec.decode(found)).hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(found, "<i4"))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(coded, schema)


def rank_table(ranks: dict[bytes, int], buckets: int = 1 << 15) -> Column:
    """The ranks as one literal: an array of small maps, chosen by CRC-32, from hexadecimal string to rank.

    A map literal is searched from its start, so one map of all strings would
    cost some 25,000 comparisons for each look-up.
    """
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for word, rank in ranks.items():
        shown = word.hex().upper()
        table[zlib.crc32(shown.encode()) % buckets][shown] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def fold_by_functions(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """Adds ``ids`` to a table of distinct binary words, by higher-order functions alone.

    The fold runs over as many steps as a word has bytes. Its state is the
    list of parts as hexadecimal strings; a step merges the pair of lowest
    rank, the first of equals. Use it for small dictionaries: see the README
    for what a look-up costs here.
    """
    buckets = 1 << 15
    table, none = F.col("_ranks"), F.lit(2 ** 31 - 1)

    def rank(part: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(part.cast("binary")), F.lit(buckets)).cast("int"))
        return F.coalesce(F.try_element_at(bucket, part), none)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p, i: F.struct(rank(F.concat(p, F.get(parts, i + 1))).alias("rank"), i.alias("at")))
        best = F.array_min(pairs)
        return F.transform(F.array(best), lambda b: F.when(
            b.isNull() | (b["rank"] == none), parts).otherwise(F.concat(
                F.slice(parts, F.lit(1), b["at"]),
                F.array(F.concat(F.get(parts, b["at"]), F.get(parts, b["at"] + 1))),
                F.slice(parts, b["at"] + 3, F.size(parts)))))[0]

    size = F.octet_length(word)
    bytes_of = F.transform(F.sequence(F.lit(1), size), lambda i: F.hex(F.substring(word, i, F.lit(1))))
    whole = F.hex(word)
    rows = words.withColumn("_ranks", rank_table(ranks, buckets)).withColumn("_bytes", bytes_of)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.col("_bytes"), step)
    parts = F.when(rank(whole) != none, F.array(whole)).otherwise(folded)
    return rows.withColumn("_parts", parts).withColumn("ids", F.transform("_parts", rank)).drop("_ranks", "_bytes", "_parts")
