"""Packing of tokenised documents into windows of even length by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.bpe import ByteCodec, read_ranks
from gridledger.llm.common import text_of
from gridledger.session import materialize

WINDOW = 1024
# What is left of a document after its whole windows is cut into even pieces of at most so many tokens.
PIECE = 256
# Windows that are packed together: more make the last, uneven share of a bin smaller and its work larger.
BIN = 512
BINS_PER_TASK = 256
ROWS = 256
LONG_TEXT = 200_000
# Sequence ids of one bin are below this; bins are even in size, as pieces are dealt out by hash.
WINDOWS_A_BIN = 1 << 24
# Fixed values of the vocabulary file: its special string and that string's id; the id that ends a document.
SPECIAL = ("<|endoftext|>", 50256)
END = 0


class Tokenizer:
    """The rank file with the pattern and special string of byte_bpe_50k.json: same ids, some five times faster.

    The fast library gives up on runs of some million spaces. Texts of more
    than LONG_TEXT characters are cut and folded here, at the special string first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.fast = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([SPECIAL]))
        self.own = ByteCodec(ranks)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        name, special = SPECIAL
        parts = []
        for i, part in enumerate(text.split(name)):
            parts += [np.array([special], "<u4")] * (i > 0) + [np.frombuffer(self.own.encode(part), "<u4")]
        return np.concatenate(parts)


def cuts(n: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole windows, then even pieces of the rest."""
    whole = [(at, window) for at in range(0, n - n % window, window)]
    rest, at = n % window, n - n % window
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        whole.append((at, length))
        at += length
    return whole


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece of every document, in one pass over the texts.

    A document is the ids of its whole text and one closing id, so the empty
    and the null text have one.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Tokenizer(ranks.value)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                out: list[list[int]] = [[], [], [], [], []]
                for doc_id, text in zip(*(column.to_pylist() for column in part.columns)):
                    ids = np.append(codec.encode(text), np.uint32(END)).astype("<u4")
                    for start, length in cuts(len(ids), window, piece):
                        row = (doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids))
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def differenced(lengths: list[int], windows: int) -> list[int]:
    """The window of each piece by multiway Karmarkar-Karp differencing.

    Every piece starts as a partition of its own. The two partitions whose
    fullest and emptiest window differ most are merged with opposing
    imbalances, the fullest window of one with the emptiest of the other, and
    what all windows have in common is taken off, until one partition is left.

    While the longest pieces left are longer than any difference so far, a
    partition takes one after the other into its empty windows, so it is made
    of as many at once. A merge keeps the order that its windows were sorted
    into, from which the windows of the pieces are read back.
    """
    if windows == 1 or len(lengths) < 2:
        return [0] * len(lengths)
    pieces = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sums: list[np.ndarray | None] = []
    made: list[list[int] | tuple[int, int, np.ndarray]] = []
    heap: list[tuple[int, int]] = []

    def add(both: np.ndarray, what: list[int] | tuple[int, int, np.ndarray]) -> None:
        both -= both[-1]
        sums.append(both)
        made.append(what)
        heapq.heappush(heap, (-int(both[0]), len(sums) - 1))

    def start(some: list[int]) -> None:
        first = np.zeros(windows, np.int64)
        first[:len(some)] = [lengths[i] for i in some]
        add(first, some)

    at = 0
    while at < len(pieces) and lengths[pieces[min(at + windows, len(pieces)) - 1]] > (-heap[0][0] if heap else 0):
        start(pieces[at:at + windows])
        at += windows
    for piece in pieces[at:]:
        start([piece])
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        sums[a] = sums[b] = None
        add(both[order], (a, b, order))
    # From the last merge back: where each window of a partition ends up.
    places: dict[int, np.ndarray] = {len(made) - 1: np.arange(windows, dtype=np.int32)}
    result = [0] * len(lengths)
    for number in range(len(made) - 1, -1, -1):
        place, what = places.pop(number), made[number]
        if isinstance(what, list):
            for piece, window in zip(what, place.tolist()):
                result[piece] = window
        else:
            a, b, order = what
            after = np.empty(windows, np.int32)
            after[order] = place
            places[a], places[b] = after, after[::-1]
    return result


def packed(lengths: list[int], window: int = WINDOW) -> list[int]:
    """The window of each piece: as few windows as the total needs, one more each time a window runs over."""
    windows = max(1, -(-sum(lengths) // window))
    while True:
        found = differenced(lengths, windows)
        if np.bincount(found, lengths).max() <= window:
            return found
        windows += 1


def sequences(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE, per_bin: int = BIN) -> DataFrame:
    """Packs every document into sequences of at most ``window`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Each
    id of a document, the closing one included, lies in exactly one piece.
    Whole windows of a long document are sequences of their own; the rest is
    cut into even pieces of at most ``piece`` tokens, and bins of about
    ``per_bin`` windows of such pieces are packed by differencing. Returns
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id`` (even for
    whole windows, odd for mixed ones) and ``offset``, gapless from 0 in each
    sequence. Null and repeated ids are packed like any other: a piece is
    known by its place in the written table. No rows give no rows.
    """
    if piece > window:
        raise ValueError("a piece must fit a window")
    rows = materialize(pieces(docs, path, window, piece).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    rest = rows.filter(F.col("length") < window)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    bins = max(1, round(tokens / (window * per_bin)))
    keyed = rest.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(bins)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        lengths = group["length"].to_numpy()
        at = np.array(packed(lengths.tolist(), window), np.int64)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        opens = np.r_[True, np.diff(at[order]) > 0]
        offset = np.empty(len(at), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(opens, before, 0))
        sequence = (group["bin"].to_numpy() * WINDOWS_A_BIN + at) * 2 + 1
        group = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # Bins cost time, not bytes: tasks are cut by their number, which merging of small partitions would not see.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bins // BINS_PER_TASK))
    mixed = keyed.repartition(tasks, "bin").groupBy("bin").applyInArrow(pack, columns)
    whole = rows.filter(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(mixed)
