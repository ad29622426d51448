"""How far the sources of a language differ in their words: hash-consed segment trees of term counts, compared in pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions.skew import lookup_join
from gridledger.llm.ordering import numbered
from gridledger.session import materialize

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# A segment tree covers so many term ids (a power of two); a task compares sources of two blocks of so many.
SEGMENT = 4096
BLOCK = 64
# Pairs that are walked through at once, and bytes of a text that are cut into terms at once.
PAIRS = 64
PIECE = 4 << 20
# Distinct terms a worker counts before it passes them on.
HELD_TERMS = 300_000
ABSENT = -1
# A byte that is part of a term stays, A-Z lower-cased; all others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """Pieces of bounded length, cut at spaces."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Counts:
    """Occurrences and documents of each term by (lang, source), of a bounded number of terms."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        if group not in self.groups:
            self.groups[group] = Counter(), Counter()
            self.held += 1
        count, documents = self.groups[group]
        self.held -= len(count)
        text = text.translate(_TERMS)
        if len(text) <= PIECE:
            terms = text.split()
            count.update(terms)
            documents.update(set(terms))
        else:
            seen: set[bytes] = set()
            for piece in _pieces(text):
                terms = piece.split()
                count.update(terms)
                seen.update(terms)
            documents.update(seen)
        self.held += len(count)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Every term once; the empty term stands for the group itself."""
        for (lang, source), (count, documents) in self.groups.items():
            terms = [b"", *count]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()), pa.array([0, *count.values()], pa.int64()),
                pa.array([0, *(documents[t] for t in count)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        self.groups.clear()
        self.held = 0


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """``lang, source, term, n`` (occurrences) and ``docs`` (documents with the term), over all documents.

    A null lang, source or text counts as empty. A group also has a row with
    the empty term and no occurrences, so groups without terms are there.
    Workers pass their counts on whenever they hold ``held`` terms.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                counts.add((lang, source), text)
                if counts.held > held:
                    yield from counts.rows()
        yield from counts.rows()

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)"))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The same by arrays: long division by thousands stays within 64 bits for up to 9 * 10**15 occurrences."""
    whole = total + 2 * terms
    result, rest = np.divmod(n + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        result = result * 1000 + digits
    return 1 + result


def hash_consed(counts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Segment trees over the rows of ``counts``, whose width is a power of two, with equal subtrees shared.

    Returns, per level from the root down, the left and right child of each
    distinct node; the distinct counts that the lowest children are; and each
    row's root.
    """
    values, nodes = np.unique(counts, return_inverse=True)
    nodes, known, levels = nodes.reshape(counts.shape), len(values), []
    while nodes.shape[1] > 1:
        both, nodes_up = np.unique(nodes[:, 0::2] * known + nodes[:, 1::2], return_inverse=True)
        levels.append((both // known, both % known))
        nodes, known = nodes_up.reshape(len(counts), -1), len(both)
    return levels[::-1], values, nodes[:, 0]


def compared(first: np.ndarray, second: np.ndarray, trees: tuple, totals: np.ndarray, terms: int) -> np.ndarray:
    """Sum of gaps over all leaves for pairs of rows of ``hash_consed``, by walking through both trees at once.

    On each level equal node pairs of a pair of rows become one with the sum
    of their multiplicities, so each is followed and priced once.
    """
    levels, values, roots = trees
    pair, a, b = np.arange(len(first)), roots[first], roots[second]
    times = np.ones(len(first), np.int64)
    for left, right in levels:
        pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
        a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
        width_a, width_b = int(a.max()) + 1, int(b.max()) + 1
        keys, place = np.unique((pair * width_a + a) * width_b + b, return_inverse=True)
        times = np.bincount(place.ravel(), times, len(keys)).astype(np.int64)
        rest, b = np.divmod(keys, width_b)
        pair, a = np.divmod(rest, width_a)
    a, b = values[a], values[b]
    real = a != ABSENT
    pair, a, b, times = pair[real], a[real], b[real], times[real]
    whole = np.full(len(pair), terms, np.int64)
    p, q = shares(a, totals[first[pair]], whole), shares(b, totals[second[pair]], whole)
    result = np.zeros(len(first), np.int64)
    np.add.at(result, pair, (p - q) * (p - q) // (p + q) * times)
    return result


def _walked(rows: pa.Table, segment: int, size: int, blocks: tuple[int, int], per_block: int) -> pa.Table:
    """All pairs of sources of two blocks, over one segment of term ids."""
    rows = rows.sort_by("place")
    names, totals = rows["source"].to_pylist(), rows["total"].to_numpy()
    terms = rows["terms"][0].as_py()
    counts = np.zeros((len(names), size), np.int64)
    counts[:, max(0, min(size, terms - segment * size)):] = ABSENT
    for row, (ids, ns) in enumerate(zip(rows["ids"], rows["ns"])):
        if ids.is_valid:
            counts[row, ids.values.to_numpy() - segment * size] = ns.values.to_numpy()
    block = rows["place"].to_numpy() // per_block
    apart = (block[:, None] == blocks[0]) & (block[None, :] == blocks[1])
    first, second = np.nonzero(apart if blocks[0] != blocks[1] else np.triu(np.ones_like(apart), 1))
    trees, sums = hash_consed(counts), [np.zeros(0, np.int64)]
    for at in range(0, len(first), PAIRS):
        sums.append(compared(first[at:at + PAIRS], second[at:at + PAIRS], trees, totals, terms))
    return pa.table({
        "lang": pa.array([rows["lang"][0].as_py()] * len(first), pa.string()),
        "source": pa.array([names[i] for i in first], pa.string()), "item": pa.array([names[j] for j in second], pa.string()),
        "value": pa.array(np.concatenate(sums), pa.int64())})


def _pairs(cells: DataFrame, groups: DataFrame, segment: int, block: int) -> DataFrame:
    """The gap between any two sources of a language: trees per segment of term ids, summed over the segments.

    Sources meet in pairs of blocks, so a task holds at most two blocks of
    rows with one segment of counts, whatever the numbers of sources and terms.
    """
    placed = numbered(groups, "lang", [F.col("source").asc()], "place", "sources")
    last = F.greatest(F.ceil(F.col("terms") / segment), F.lit(1)) - 1
    present = placed.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    held = cells.groupBy("lang", "source", F.floor(F.col("id") / segment).cast("long").alias("segment")).agg(
        F.collect_list(F.struct("id", "n")).alias("cells"))
    rows = present.join(held, ["lang", "source", "segment"], "left")
    own, other = F.floor(F.col("place") / block).cast("long"), F.col("other")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / block).cast("long"))).alias("other"))
    rows = rows.select(
        "lang", "segment", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "source", "place", "total",
        "terms", F.col("cells.id").alias("ids"), F.col("cells.n").alias("ns"))
    def walk(key: tuple, group: pa.Table) -> pa.Table:
        _, at, low, high = (k.as_py() for k in key)
        return _walked(group, at, segment, (low, high), block)

    sums = rows.groupBy("lang", "segment", "low", "high").applyInArrow(walk, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, segment: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """How far each (lang, source) group is from the other sources of its language, and its most typical terms.

    ``docs`` needs ``lang, source, text``; other columns are not read, null
    values count as empty. A language keeps the terms that at least
    ``least_documents`` of its documents hold. A term's share in a group or
    language is smoothed and scaled to whole numbers, the gap of two shares is
    their squared difference by their sum. Returns ``lang, source, part, item,
    value, rank``: for part ``pair`` every other source of the language with
    the sum of gaps over all kept terms (0 where none is kept); for part
    ``term`` the ``top`` terms whose share is above the language's. Ranks go
    by value, then item. Repeated rows count each time. No rows give no rows.
    """
    counts = materialize(term_counts(docs), "term-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    ids = numbered(
        kept.filter(F.col("docs") >= least_documents).drop("docs"), "lang", [F.col("in_lang").desc(), F.col("term").asc()], "id", "terms")
    ids = materialize(ids, "term-ids")
    cells = materialize(counts.drop("docs").join(ids.drop("terms"), ["lang", "term"]), "term-cells")
    langs = ids.groupBy("lang").agg(F.first("terms").alias("terms"), F.sum("in_lang").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left")
    groups = lookup_join(groups, langs, ["lang"], ["source"], "left").fillna(0, ["total", "terms", "lang_total"])
    groups = materialize(groups, "term-groups")
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    typical = lookup_join(cells.filter("n > 0"), groups, ["lang", "source"], ["id"], "inner").select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    typical = typical.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    pairs = _pairs(cells, groups.select("lang", "source", "total", "terms"), segment, block)
    return ranked(pairs, "pair").unionByName(ranked(typical, "term").filter(F.col("rank") <= top))
