"""Merkle manifest of a dataset, with the proof of every document found by pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.skew import lookup_join
from gridledger.llm.ordering import numbered
from gridledger.session import materialize

FANOUT = 16
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Trees are named by "=" and their source, the null source by the empty string; this one holds the subroots.
TOP = "#"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NODE = ["tree", "level", "pos"]
_UP = ["up_tree", "up_level", "up_pos"]
_STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(text: Column) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its value, a null one as a hyphen."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [text]
    return digest(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def tampered() -> Column:
    """Rows that the audit tampers with: 5 divides the CRC-32 of the decimal id; a null id is left alone."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf`` and ``altered``, the leaf of the tampered row, null where nothing is tampered."""
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    return docs.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        leaf_of(F.col("text")).alias("leaf"), F.when(tampered(), leaf_of(lowered)).alias("altered"))


def _joined(items: Column) -> Column:
    return F.array_join(items, "")


def _upwards(nodes: DataFrame, widest: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Merges each tree's nodes (``tree, level, pos, width, digest, id``) until one is left.

    Gives one written table per level, with a row for every run of ``fanout``
    nodes (``kids``, its parent's digest and width), and the last node of each tree.
    """
    levels, last = [], [nodes.filter("width = 1")]
    while widest > 1:
        runs = nodes.filter("width > 1").groupBy("tree", "level", F.floor(F.col("pos") / fanout).cast("long").alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest", "id"))).alias("kids"), F.first("width").alias("width"))
        runs = materialize(runs.select(
            "tree", "level", "run", "kids", digest(_joined(F.col("kids.digest"))).alias("digest"),
            F.ceil(F.col("width") / fanout).cast("long").alias("width")), "merkle-level")
        levels.append(runs)
        level = F.col("level") + 1
        nodes = runs.select(
            "tree", level.alias("level"), F.col("run").alias("pos"), "width", "digest",
            F.struct("tree", level.alias("level"), F.col("run").alias("pos")).alias("id"))
        last.append(nodes.filter("width = 1"))
        widest = -(-widest // fanout)
    return levels, reduce(DataFrame.unionByName, last)


def _siblings(kids: Column, at: Column) -> Column:
    """The digests of the run before and after a place, each as one string."""
    return F.struct(
        _joined(F.slice(kids, F.lit(1), at)).alias("before"),
        _joined(F.slice(kids, at + 2, F.greatest(F.size(kids) - at - 1, F.lit(0)))).alias("after"))


def _edges(levels: list[DataFrame], lone_root: bool) -> DataFrame:
    """For every merged node one step: where it leads (null: the root), the siblings, and the subroot once it is passed."""
    found = []
    for runs in levels:
        rows = runs.select("*", F.posexplode("kids").alias("at", "kid"))
        ends = F.col("width") == 1
        at_root = ends & (F.lit(True) if lone_root else F.col("tree") == TOP)
        up = F.struct("tree", F.col("level") + 1, "run")
        found.append(rows.select(
            *[F.col(f"kid.id.{c}").alias(c) for c in _NODE],
            *[F.when(~at_root, up[c]).alias(n) for c, n in zip(("tree", "col2", "run"), _UP)],
            F.array(_siblings(F.col("kids.digest"), F.col("at"))).cast(_STEP).alias("path"),
            F.when(F.col("tree") == TOP, F.when(F.col("level") == 0, F.col("kid.digest")))
            .otherwise(F.when(ends, F.col("digest"))).alias("subroot")))
    return reduce(DataFrame.unionByName, found)


def _jumped(edges: DataFrame, depth: int) -> DataFrame:
    """Joins the table with itself until every path reaches the root; each round doubles how far a path leads.

    A node ``reach`` steps below its ancestor takes over that ancestor's path,
    so after a round with reach r only nodes above level r are asked for: their
    table shrinks by the fan-out to the power of r. It is broadcast if it is
    small and otherwise joined with hot ancestors split.
    """
    table, reach = materialize(edges, "merkle-steps"), 1
    while reach < depth:
        asked = table.filter((F.col("tree") == TOP) | (F.col("level") > reach)).select(
            *[F.col(c).alias(n) for c, n in zip(_NODE, _UP)], F.struct(*_UP).alias("_next"),
            F.col("path").alias("_path"), F.col("subroot").alias("_subroot"))
        moving = table.filter(F.col("up_tree").isNotNull())
        joined = lookup_join(moving, asked, _UP, _NODE, "left").select(
            *_NODE, *[F.col(f"_next.{n}").alias(n) for n in _UP],
            F.concat("path", F.coalesce("_path", F.array().cast(_STEP))).alias("path"),
            F.coalesce("subroot", "_subroot").alias("subroot"))
        table = materialize(joined.unionByName(table.filter(F.col("up_tree").isNull())), "merkle-paths")
        reach *= 2
    return table


def _height(widest: int, fanout: int) -> int:
    height = 0
    while widest > 1:
        widest, height = -(-widest // fanout), height + 1
    return height


def proofs(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every document's leaf, its subroot, the root, and the path of siblings that leads there.

    ``docs`` needs ``doc_id, source, lang, n_chars, text``; other columns are
    not read. Leaves of a source ascend by ``doc_id`` (null first, ties by
    leaf); runs of ``fanout`` nodes become their digest until one, the subroot,
    is left; subroots, ordered by source (null first), give the root likewise.
    ``path`` has a pair (``before``, ``after``) of concatenated sibling digests
    for every level; it is empty for the only document of an only source.
    ``altered`` is the leaf of the tampered row or null. Each row gives one
    row, a repeated one too; no rows give none.

    Paths are found for runs of leaves, not for single leaves: a run's
    members are laid beside the one path of their parent and told apart only
    in the last step, so no path is moved for each document.
    """
    placed = materialize(numbered(leaves(docs), "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "pos", "width"), "merkle-leaves")
    widest = placed.agg(F.max("width")).first()[0] or 0
    runs = placed.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "leaf", "doc_id", "altered"))).alias("members"), F.first("width").alias("width"))
    lone = F.col("width") == 1
    runs = materialize(runs.withColumn("level", F.when(lone, 0).otherwise(1)), "merkle-runs")
    nodes = runs.select(
        "tree", "level", F.col("run").alias("pos"), F.ceil(F.col("width") / fanout).cast("long").alias("width"),
        F.when(lone, F.col("members")[0]["leaf"]).otherwise(digest(_joined(F.col("members.leaf")))).alias("digest"),
        F.struct("tree", "level", F.col("run").alias("pos")).alias("id"))
    levels, subroots = _upwards(nodes, -(-widest // fanout), fanout)
    ranked = numbered(
        subroots.select(F.lit(TOP).alias("top"), "tree", "digest", "id"), "top", [F.col("tree").asc()], "pos", "width")
    ranked = materialize(ranked.select(
        F.col("top").alias("tree"), F.lit(0).alias("level"), "pos", "width", "digest", "id"), "merkle-subroots")
    sources = ranked.count()
    above, root = _upwards(ranked, sources, fanout)
    root = root.select("digest").first()
    if levels or above:
        paths = _jumped(_edges(levels + above, sources == 1), _height(widest, fanout) + _height(sources, fanout))
    else:
        paths = docs.sparkSession.createDataFrame(
            [], f"tree string, level int, pos long, up_tree string, up_level int, up_pos long, path {_STEP}, subroot string")
    keyed = paths.select("tree", "level", F.col("pos").alias("run"), "path", "subroot")
    rows = runs.join(keyed, ["tree", "level", "run"], "left").select("*", F.posexplode("members").alias("at", "member"))
    rest = F.coalesce("path", F.array().cast(_STEP))
    own = F.array(_siblings(F.col("members.leaf"), F.col("at"))).cast(_STEP)
    root = F.lit(root[0] if root else None).cast("string")
    return rows.select(
        F.col("member.doc_id").alias("doc_id"), F.col("member.leaf").alias("leaf"), F.col("member.altered").alias("altered"),
        F.coalesce("subroot", root).alias("subroot"), root.alias("root"),
        F.when(F.col("width") > 1, F.concat(own, rest)).otherwise(rest).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Digests of ``proofs``: the path as one digest, and the root recomputed from the tampered, else the original, leaf.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root`` and
    ``verified`` (the recomputed root is the root).
    """
    path = F.col("path")
    rows = proofs(docs, fanout).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(_joined(F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), path).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
