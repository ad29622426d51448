"""Near-duplicates: MinHash signatures, a multi-index Hamming join, and links confirmed on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.skew import split_join
from gridledger.llm.common import given_back, join_checked, join_groups, text_of
from gridledger.llm.wordhash import mix, runs_of, separators, word_hashes
from gridledger.session import materialize

WORDS = 5
# A link needs 100 * common >= 75 * all.
SIMILARITY = 75
# A signature has 32 symbols of b = 16 bits, kept as eight chunks of four symbols.
CHUNKS = 8
SYMBOLS = 4 * CHUNKS
BITS = 16
# Pairs with fewer common symbols are not compared. At the similarity of 0.75 a
# pair has 24 of 32 on average; 11 or fewer happen once in some 10 million.
MIN_COMMON = 12
# Neighbourhoods of at most so many members are compared pair by pair, larger ones in blocks.
SMALL = 64
BLOCK = 256
# Bytes of a text that are cut into words at once.
PIECE = 1 << 18
_SIGNATURE = [f"s{c}" for c in range(CHUNKS)]
_NODE = ["n_shingles", *_SIGNATURE]


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64))
    return values[:SYMBOLS] | np.uint64(1), values[SYMBOLS:]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set, the lowest 16 bits of its minimum under each hash function, as eight 64-bit chunks."""
    factors, shifts = _hash_functions()
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), CHUNKS), np.uint64)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat(mix(joined * factors[j] + shifts[j]), starts)
        out[:, j // 4] |= (least & np.uint64(0xFFFF)) << np.uint64(BITS * (j % 4))
    return out


def _words_digest(text: str) -> bytes:
    """Digest of the words in order, of a long text piece by piece."""
    digest, data, at = hashlib.sha256(), text.encode().lower(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        for_piece = b" ".join(data[at:end].split())
        digest.update(for_piece + b" " * bool(for_piece))
        at = end
    return digest.digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = separators()
    for batch in given_back(batches):
        for at, words, places in word_hashes(batch.column(1), ends):
            sets = [np.unique(runs_of(words[a:b], WORDS)) for a, b in zip(places[:-1], places[1:])]
            ids = np.zeros((len(sets), 2), np.int64)
            signatures = np.zeros((len(sets), CHUNKS), np.uint64)
            full = [i for i, s in enumerate(sets) if len(s)]
            for i in full:
                ids[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
            if full:
                signatures[full] = _signatures([sets[i] for i in full])
            same = [_words_digest(t.as_py()) for t in batch.column(1).slice(at, len(sets))]
            columns = [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(c) for c in (ids[:, 0], ids[:, 1], *signatures.view(np.int64).T)] + [pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", *_SIGNATURE, "words"])


def described(docs: DataFrame) -> DataFrame:
    """Per row: number of distinct shingles, a 128-bit digest of their set, its signature, and a digest of the words in order."""
    longs = ", ".join(f"{c} long" for c in ["n_shingles", "set_a", "set_b", *_SIGNATURE])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        _describe, f"doc_id long, {longs}, words binary")


def chunk_keys(chunk: Column, family: int) -> list[Column]:
    """Keys under which chunks meet that differ in at most one of four symbols: each symbol left out in turn."""
    masks = [~(0xFFFF << (BITS * i)) & 0xFFFFFFFFFFFFFFFF for i in range(4)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return [F.xxhash64(F.lit(4 * family + i), chunk.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]


def common_symbols(left: str, right: str) -> Column:
    """Equal symbols of two signatures: lanes of 16 bits that are zero in the exclusive or."""
    total = F.lit(0)
    for c in _SIGNATURE:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + 4 - F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _may_link(left: str, right: str) -> Column:
    """What every linked pair fulfils: sizes within the similarity, enough common symbols."""
    small = F.least(f"{left}.n_shingles", f"{right}.n_shingles")
    large = F.greatest(f"{left}.n_shingles", f"{right}.n_shingles")
    return (small * 100 >= large * SIMILARITY) & (common_symbols(left, right) >= MIN_COMMON)


def _shingles(text: str) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(WORDS)]))


def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the sets of two texts reach the similarity; sets are built from words, not from hashes."""
    out, last_text, last_set = [], None, set()
    for x, y in zip(a, b):
        x, y = x.as_py(), y.as_py()
        if y != last_text:
            last_text, last_set = y, _shingles(y)
        own = _shingles(x)
        common = len(own & last_set)
        out.append(100 * common >= SIMILARITY * (len(own) + len(last_set) - common))
    return pa.array(out, pa.bool_())


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the given ids, one row each."""
    wanted = materialize(ids.select(F.col("id").alias("doc_id")), "near-ids")
    return join_checked(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), wanted, ["doc_id"],
        "left_semi").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose whole texts are linked.

    Only texts named in pairs are moved. A document in many pairs is repeated
    over splits of 2,000 pairs.
    """
    linked = F.arrow_udf(_linked, "boolean")
    texts = _texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    both = split_join(pairs.select("a", "b"), of("b"), ["b"], ["a"], "inner", 2000)
    both = split_join(both, of("a"), ["a"], ["b"], "inner", 2000)
    return both.filter(linked("text_a", "text_b")).select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Smallest reachable id per linked id: ``id, component``.

    Each round takes the smallest label among an id and its neighbours and then
    the label of that label, so labels travel twice as far in each round. A
    round is one written table; nothing but a change count reaches the driver.
    """
    edges = links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b"))) if known is not None else links
    edges = edges.filter("a <> b")
    both = materialize(edges.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(),
        "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        least = labels.join(near, "id").select(
            "id", F.least("component", "_near").alias("component"), F.col("component").alias("_before"))
        further = labels.select(F.col("id").alias("component"), F.col("component").alias("_further"))
        moved = materialize(least.join(further, "component", "left").select(
            "id", F.least("component", F.coalesce("_further", "component")).alias("component"), "_before"), "labels")
        labels = moved.select("id", "component")
        if moved.filter("component <> _before").isEmpty():
            return labels


def _with_component(rows: DataFrame, id_column: str, labels: DataFrame, name: str) -> DataFrame:
    found = labels.select(F.col("id").alias(id_column), F.col("component").alias(name))
    return join_checked(rows, found, [id_column], "left").withColumn(name, F.coalesce(name, id_column))


def _candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that may link, with the number of common symbols."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.struct(*_NODE).alias(f"node_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_may_link("node_a", "node_b")).select(
        "a", "b", common_symbols("node_a", "node_b").alias("common"))


def _roots(parents: DataFrame) -> DataFrame:
    """Root of each id in a forest of (a, b) with b < a, one row per a: ``id, component``.

    Each round replaces a parent by the parent's parent, so depth halves.
    """
    labels = parents.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("_above"))
        moved = materialize(join_checked(labels, above, ["component"], "left").select(
            "id", F.coalesce("_above", "component").alias("component"), F.col("_above").isNotNull().alias("_moved")), "roots")
        labels = moved.select("id", "component")
        if moved.filter("_moved").isEmpty():
            return labels


def _met(keyed: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's first member: distinct (a, b) with b < a."""
    buckets = keyed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("_rows")).filter("_rows > 1")
    buckets = materialize(buckets, "near-buckets")
    total = buckets.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    text_key = F.col("key").cast("string").alias("key")
    met = join_groups(
        keyed.select(text_key, "id"), buckets.withColumn("key", text_key), "key", "_rows", total, "id")
    return materialize(met.filter("b <> id").select(F.col("id").alias("a"), "b").distinct(), "near-met")


def _star_links(met: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Components from links between members of buckets and their first members.

    The most promising such pair of each member is confirmed first. These
    links form a forest, which joins most of any large group; then the pairs
    that still lie between two of its trees are confirmed.
    """
    stars = materialize(_candidates(met, nodes), "near-stars")
    if stars.isEmpty():
        return None
    best = materialize(
        stars.groupBy("a").agg(F.max(F.struct("common", "b")).alias("_best")).select("a", "_best.b"), "near-best")
    labels = _roots(materialize(confirmed(best, docs), "near-forest"))
    apart = _with_component(_with_component(stars, "a", labels, "_ca"), "b", labels, "_cb").filter("_ca <> _cb")
    rest = materialize(apart.select("a", "b").join(best, ["a", "b"], "left_anti"), "near-rest")
    return labels if rest.isEmpty() else components(confirmed(rest, docs), labels)


def _mixed(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of neighbourhoods that lie in several components.

    All members of a bucket share its first member, so two documents that meet
    anywhere are in the neighbourhood of one first member. A member outside
    the largest component of its neighbourhood is a stray.
    """
    members = met.select(F.col("b").alias("hub"), F.col("a").alias("id")).unionByName(
        met.select(F.col("b").alias("hub"), F.col("b").alias("id")).distinct())
    members = members.withColumn("component", F.col("id")) if labels is None else _with_component(
        members, "id", labels, "component")
    members = materialize(members, "near-members")
    counted = members.groupBy("hub", "component").agg(F.count("*").alias("_n"))
    mixed = counted.groupBy("hub").agg(
        F.max(F.struct("_n", "component")).alias("_top"), F.sum("_n").alias("_rows"), F.count("*").alias("_parts")
    ).filter("_parts > 1").select("hub", F.col("_top.component").alias("_largest"), "_rows")
    return join_checked(members, materialize(mixed, "near-mixed"), ["hub"], "inner").withColumn(
        "stray", F.col("component") != F.col("_largest")).drop("_largest")


def _small_pairs(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of strays with other members in neighbourhoods of at most SMALL members."""
    own = mixed.filter(F.col("_rows") <= SMALL).join(nodes.select("id", F.struct(*_NODE).alias("node")), "id")
    side = lambda rows, s: rows.select(
        "hub", F.col("id").alias(s), F.col("component").alias(f"_c{s}"), F.col("stray").alias(f"_s{s}"), F.col("node").alias(f"node_{s}"))
    left, right = side(own.filter("stray"), "a"), side(own, "b")
    return left.join(
        right, (left["hub"] == right["hub"]) & (F.col("_ca") != F.col("_cb")) & (~F.col("_sb") | (F.col("a") > F.col("b")))
        & _may_link("node_a", "node_b")).select("a", "b").distinct()


def _blocks(mixed: DataFrame) -> DataFrame:
    """Large neighbourhoods cut into pairs of blocks: strays of one with members of the other, some 256 each."""
    count = F.ceil(F.col("_rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), count).cast("int")
    large = mixed.filter(F.col("_rows") > SMALL).withColumns({"_count": count, "_own": block})
    every = F.explode(F.sequence(F.lit(0), F.col("_count") - 1))
    strays = large.filter("stray").select(
        "hub", F.col("_own").alias("rows"), every.alias("columns"), "id", "component", "stray", F.lit(True).alias("is_row"))
    others = large.select(
        "hub", every.alias("rows"), F.col("_own").alias("columns"), "id", "component", "stray", F.lit(False).alias("is_row"))
    return strays.unionByName(others)


def _open_cells(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Rows, columns and the cells of a block that are to be compared.

    As in small neighbourhoods: other component, each pair of strays once, sizes and signatures that allow a link.
    """
    part = part.sort_values(["is_row", "id"])
    rows, columns = part[part["is_row"]], part[~part["is_row"]]
    a, b = rows["id"].to_numpy()[:, None], columns["id"].to_numpy()[None]
    cells = rows["component"].to_numpy()[:, None] != columns["component"].to_numpy()[None]
    cells &= ~columns["stray"].to_numpy()[None] | (a > b)
    if cells.any():
        n, m = rows["n_shingles"].to_numpy()[:, None], columns["n_shingles"].to_numpy()[None]
        cells &= np.minimum(n, m) * 100 >= np.maximum(n, m) * SIMILARITY
        x = np.ascontiguousarray(rows[_SIGNATURE].to_numpy(np.int64)).view(np.uint16)
        y = np.ascontiguousarray(columns[_SIGNATURE].to_numpy(np.int64)).view(np.uint16)
        common = np.zeros(cells.shape, np.int16)
        for j in range(SYMBOLS):
            common += x[:, j][:, None] == y[:, j][None]
        cells &= common >= MIN_COMMON
    return rows, columns, cells


def _active(part: pd.DataFrame) -> pd.DataFrame:
    """The rows and columns of a block with a cell to compare."""
    rows, columns, cells = _open_cells(part)
    keep = np.concatenate([cells.any(axis=0), cells.any(axis=1)])  # columns stand before rows
    return pd.concat([columns, rows])[keep]


def _block_links(part: pd.DataFrame) -> pd.DataFrame:
    """The links of a block, one per stray and component, by the counts of common shingles of all its cells."""
    rows, columns, cells = _open_cells(part)
    sets = [_shingles(t) for t in [*rows["text"], *columns["text"]]]
    size = np.array([len(s) for s in sets])
    seen = set().union(*sets[:len(rows)]) & set().union(*sets[len(rows):])
    place = {shingle: i for i, shingle in enumerate(seen)}
    common = np.zeros(cells.shape, np.float32)
    held = [np.fromiter((place[x] for x in s if x in place), np.int64) for s in sets]
    for start in range(0, len(place), 4096):
        grid = np.zeros((len(sets), min(4096, len(place) - start)), np.float32)
        for i, h in enumerate(held):
            grid[i, h[(h >= start) & (h < start + grid.shape[1])] - start] = 1
        common += grid[:len(rows)] @ grid[len(rows):].T
    every = size[:len(rows)][:, None] + size[len(rows):][None] - common
    a, b = np.nonzero(cells & (100 * common >= SIMILARITY * every))
    found = pd.DataFrame({
        "a": rows["id"].to_numpy()[a], "b": columns["id"].to_numpy()[b], "component": columns["component"].to_numpy()[b]})
    return found.drop_duplicates(["a", "component"])[["a", "b"]]


def _large_links(mixed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of strays in neighbourhoods of more than SMALL members.

    Pairs never become rows: a task holds one block, first of signatures, then
    of the texts of those members that have a partner worth comparing.
    """
    key = ["hub", "rows", "columns"]
    blocks = _blocks(mixed).join(nodes, "id")
    names = ["hub", "rows", "columns", "id", "component", "stray", "is_row", *_NODE]
    columns = "hub long, rows int, columns int, id long, component long, stray boolean, is_row boolean, " + ", ".join(
        f"{c} long" for c in _NODE)
    active = blocks.groupBy(*key).applyInPandas(lambda part: _active(part)[names], columns)
    active = materialize(active, "near-active")
    texts = _texts_of(docs, active.select("id").distinct()).withColumnRenamed("doc_id", "id")
    return split_join(active, texts, ["id"], ["hub", "rows", "columns"], "inner", 2000).groupBy(*key).applyInPandas(
        _block_links, "a long, b long")


def _equal_sets(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``_set``, the same for rows whose sets are equal.

    Texts of the same words in the same order have equal sets. Of texts that
    have only the digest of their set in common, one of each is compared with
    the one of smallest id on whole sets; if they are not linked, which takes
    a collision of hashes, its rows have a set of their own.
    """
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    texts = materialize(some.groupBy("set_a", "set_b", "words").agg(F.min("doc_id").alias("a")), "near-texts")
    several = texts.groupBy("set_a", "set_b").agg(F.min("a").alias("b"), F.count("*").alias("_texts")).filter("_texts > 1")
    pairs = materialize(join_checked(texts, several, ["set_a", "set_b"], "inner").filter("a <> b").select("a", "b", "words"), "near-equal")
    own = F.concat_ws(":", "set_a", "set_b")
    if not pairs.isEmpty():
        apart = materialize(pairs.join(confirmed(pairs.select("a", "b"), docs), ["a", "b"], "left_anti").select("words"), "near-apart")
        if not apart.isEmpty():
            rows = join_checked(rows, apart.withColumn("_apart", F.lit(True)), ["words"], "left")
            return rows.withColumn("_set", F.when(F.col("_apart"), F.concat_ws(":", own, F.hex("words"))).otherwise(own))
    return rows.withColumn("_set", own)


def near_components(docs: DataFrame) -> DataFrame:
    """Groups of linked documents.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A-Z
    are lower-cased, words are cut at ASCII white space, and a text's set has
    its runs of five words, or its only run if it has fewer. Documents are
    linked if 100 * common >= 75 * all of both sets, confirmed on whole texts.
    Returns ``doc_id, n_shingles, component_id`` (smallest id reachable over
    links) and ``kept`` (``doc_id`` = ``component_id``). A null or blank text
    has no shingles and no link. A row without id has no link and is kept,
    with a null component. Rows that repeat an id repeat its result; rows of
    one id are taken to have one text.

    Equal sets, confirmed on whole texts, are one node. Signatures of 32 symbols are cut into eight
    chunks; a pair with at most 15 different symbols has by the pigeonhole
    principle a chunk with at most one, and each chunk is indexed under all
    four keys that leave one symbol out, so every such pair meets. Pairs with
    up to 20 different symbols are compared as well where they meet. A pair of
    similarity 0.75 meets with probability 1 - 0.262^8, all but 1 in 45,000.
    """
    rows = _equal_sets(materialize(described(docs), "near-rows"), docs)
    sets = materialize(
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("_set", *_NODE).agg(
            F.min("doc_id").alias("id"), F.count("*").alias("_rows")), "near-sets")
    nodes = sets.select("id", *_NODE)
    keys = [k for c, name in enumerate(_SIGNATURE) for k in chunk_keys(F.col(name), c)]
    keyed = nodes.select("id", F.explode(F.array(*keys)).alias("key"))
    met = _met(keyed)
    labels = _star_links(met, nodes, docs)
    mixed = materialize(_mixed(met, labels), "near-mixed-members")
    pairs = materialize(_small_pairs(mixed, nodes), "near-pairs")
    links = materialize(confirmed(pairs, docs).unionByName(_large_links(mixed, nodes, docs)), "near-links")
    if not links.isEmpty():
        labels = components(links, labels)
    groups = sets.select("_set", "id", "_rows")
    groups = groups.withColumn("component", F.col("id")) if labels is None else groups.join(
        labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = materialize(groups.filter("_rows > 1 OR component <> id").select("_set", "component", "_rows"), "near-groups")
    total = rows.count()
    own_set = F.when(F.col("n_shingles") > 0, F.col("_set")).otherwise(
        F.concat(F.lit("empty:"), F.coalesce("doc_id", F.lit(0)).cast("string")))
    found = join_groups(rows.select("doc_id", "n_shingles", own_set.alias("_set")), groups, "_set", "_rows", total, "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


