"""Contract text to chunks, registry rows, metadata and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridledger import fixed_values as fv
from gridledger.functions.scalars import (
    LINE_BREAK, clause_type, heading_candidate, heading_of, let, read_piece, squash, strip, text_blocks,
)
from gridledger.operators.silver import latest


def text_lines(text: Column, page: int = 1) -> Column:
    """Array of non-blank trimmed lines with their page."""
    trimmed = F.transform(F.split(text, LINE_BREAK), strip)
    kept = F.filter(trimmed, lambda line: line != "")
    return F.transform(kept, lambda line: F.struct(F.lit(page).alias("page"), line.alias("text")))


def to_lines(docs: DataFrame, text: str = "raw_text_content") -> DataFrame:
    """Documents with a ``lines`` array in place of the text."""
    return docs.withColumn("lines", text_lines(F.col(text))).drop(text)


def group_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines from a layout service, one row each, to one ``lines`` array per document."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col("page").alias("page"), F.col("text").alias("text"))))
    return lines.groupBy(*keys).agg(
        F.transform(ordered, lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("lines")
    )


def explode_lines(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.posexplode("lines").alias("line_no", "line")).select(*keys, "line_no", "line.*")


def detect_headings(lines: DataFrame) -> DataFrame:
    return lines.withColumn("heading", heading_candidate(F.col("text")))


def assign_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line rows with section number and inherited heading.

    A heading equal to the one in force does not open a section.
    """
    order = W.partitionBy(*keys).orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    before = F.last("heading", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("heading").isNotNull() & ~F.col("heading").eqNullSafe(before)
    return (
        detect_headings(lines)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("section_no", F.sum("_opens").over(so_far).cast("int"))
        .withColumn("section_heading", F.last("heading", ignorenulls=True).over(so_far))
        .drop("_opens", "heading")
    )


def section_array(lines: Column) -> Column:
    """Sections of one document as array<struct<heading, page, text, clean>>.

    ``clean`` is the text with white space squashed. Works inside the row: a
    document is one cell, so nothing is shuffled, and every line is looked at
    once.
    """

    def read(line: Column) -> Column:
        return let(squash(line["text"]), lambda clean: F.struct(
            line["page"].alias("page"), line["text"].alias("text"), clean.alias("clean"),
            heading_of(line["text"], clean).alias("heading"),
        ))

    def openings(all_lines: Column) -> Column:
        marked = F.transform(all_lines, lambda x, i: F.struct(i.alias("at"), x["heading"].alias("heading")))
        heads = F.filter(marked, lambda m: m["heading"].isNotNull())
        return let(heads, lambda hs: F.filter(hs, lambda h, j: ~h["heading"].eqNullSafe(F.get(hs, j - 1)["heading"])))

    def starts(all_lines: Column, opened: Column) -> Column:
        preface = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("heading"))
        has_preface = (F.size(all_lines) > 0) & (F.coalesce(F.get(opened, F.lit(0))["at"], F.lit(-1)) != 0)
        return F.when(has_preface, F.concat(F.array(preface), opened)).otherwise(opened)

    def assemble(all_lines: Column, begin: Column) -> Column:
        def section(s: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(begin, j + 1)["at"], F.size(all_lines))
            body = F.slice(all_lines, s["at"] + 1, stop - s["at"])
            return F.struct(
                s["heading"].alias("heading"),
                F.get(all_lines, s["at"])["page"].alias("page"),
                F.array_join(body["text"], " ").alias("text"),
                F.array_join(body["clean"], " ").alias("clean"),
            )
        return F.transform(begin, section)

    return let(F.transform(lines, read), lambda ls: let(openings(ls), lambda op: let(starts(ls, op), lambda st: assemble(ls, st))))


def _last_index(window: Column, mark: str) -> Column:
    """Zero-based position of the last ``mark`` in ``window``, or -1."""
    back = F.instr(F.reverse(window), mark[::-1])
    return F.when(back > 0, F.length(window) - (len(mark) - 1) - back).otherwise(F.lit(-1))


def split_text(text: Column, max_chars: int = fv.SPLIT_MAX_CHARS, overlap_chars: int = fv.SPLIT_OVERLAP_CHARS) -> Column:
    """Array of overlapping parts of at most ``max_chars``."""
    return split_clean(squash(text), max_chars, overlap_chars)


def split_clean(
    clean: Column, max_chars: int = fv.SPLIT_MAX_CHARS, overlap_chars: int = fv.SPLIT_OVERLAP_CHARS
) -> Column:
    """The same for text whose white space is squashed already.

    A part ends after the last sentence or clause mark when that lies far
    enough into it. Only cut positions are carried from step to step.
    """
    fill = int(max_chars * fv.SPLIT_MIN_FILL)
    advance = max(1, min(fill + 2, max_chars) - overlap_chars)

    def cuts(size: Column, blocks: Column) -> Column:
        steps = F.sequence(F.lit(1), F.ceil(size / advance).cast("int") + 1)
        spans = "array<struct<from:int,to:int>>"
        first = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

        def step(state: Column, _: Column) -> Column:
            at = state["at"]
            hard = F.least(at + max_chars, size)
            window = read_piece(blocks, at, hard - at)

            def close(w: Column) -> Column:
                mark = F.greatest(_last_index(w, ". "), _last_index(w, "; "))
                return F.when((hard < size) & (mark > fill), at + mark + 1).otherwise(hard)

            def grow(to: Column) -> Column:
                span = F.struct(at.alias("from"), to.alias("to"))
                following = F.when(to >= size, F.lit(-1)).otherwise(F.greatest(to - overlap_chars, at + 1))
                return F.struct(
                    following.cast("int").alias("at"),
                    F.concat(state["spans"], F.array(span)).cast(spans).alias("spans"),
                )

            return F.when(at < 0, state).otherwise(let(let(window, close), grow))

        found = F.aggregate(steps, first, step, lambda s: s["spans"])
        return F.transform(found, lambda s: F.trim(read_piece(blocks, s["from"], s["to"] - s["from"])))

    def split(whole: Column) -> Column:
        long = let(F.length(whole), lambda size: let(text_blocks(whole, max_chars), lambda b: cuts(size, b)))
        return F.when(F.length(whole) <= max_chars, F.array(whole)).otherwise(long)

    return let(clean, split)


def window_array(text: Column, size: int = fv.WINDOW_CHARS, overlap: int = fv.WINDOW_OVERLAP_CHARS) -> Column:
    """Fixed-size overlapping windows over the raw text; empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    return let(text_blocks(text, size), lambda blocks: F.transform(
        F.coalesce(starts, F.array().cast("array<int>")), lambda s: read_piece(blocks, s, F.lit(size))
    ))


def window_chunks(
    docs: DataFrame, keys: list[str], text: str, size: int = fv.WINDOW_CHARS, overlap: int = fv.WINDOW_OVERLAP_CHARS
) -> DataFrame:
    return docs.select(*keys, F.posexplode(window_array(F.col(text), size, overlap)).alias("chunk_index", "text_snippet"))


def sections(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.posexplode(section_array(F.col("lines"))).alias("section_no", "s")).select(
        *keys, "section_no", F.col("s.heading").alias("section_heading"), F.col("s.page").alias("page_number"),
        F.col("s.text").alias("section_text"),
    )


def table_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: c["content"]), " | ")


def table_chunks(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Extracted tables as chunk rows; clause class falls back to ``table``."""
    text = table_text(F.col("cells"))
    return (
        tables.withColumn("text_snippet", strip(text))
        .filter(F.col("text_snippet") != "")
        .select(
            *keys, "table_index", "page_number",
            F.lit("TABLE").alias("section_heading"),
            F.coalesce(clause_type("text_snippet"), F.lit("table")).alias("clause_type"),
            "text_snippet",
            F.to_json(
                F.struct(F.lit("table").alias("kind"), "page_number", "table_index", "cells"),
                {"ignoreNullFields": "false"},
            ).alias("source_locator"),
        )
    )


def build_chunks(docs: DataFrame, keys: list[str], tables: DataFrame | None = None) -> DataFrame:
    """Chunk rows of each document: text sections in order, then its tables.

    ``docs`` has the keys and a ``lines`` array. Numbers are given before empty
    text is dropped, so they may have gaps.
    """
    parts = F.flatten(F.transform(
        section_array(F.col("lines")),
        lambda s: F.transform(
            split_clean(s["clean"]),
            lambda part: F.struct(
                s["page"].alias("page_number"), s["heading"].alias("section_heading"), part.alias("text_snippet")
            ),
        ),
    ))
    if tables is None:
        text = docs.select(*keys, F.posexplode(parts).alias("chunk_index", "c")).select(*keys, "chunk_index", "c.*")
        return _finish_text(text, keys)

    pieces = docs.select(*keys, parts.alias("parts"))
    counted = pieces.select(*keys, F.size("parts").alias("_before"))
    text = pieces.select(*keys, F.posexplode("parts").alias("chunk_index", "c")).select(*keys, "chunk_index", "c.*")
    order = W.partitionBy(*keys).orderBy("table_index")
    tabled = (
        table_chunks(tables, keys)
        .withColumn("_place", F.row_number().over(order) - 1)
        .join(counted, keys)
        .withColumn("chunk_index", F.col("_before") + F.col("_place"))
        .drop("table_index", "_place", "_before")
    )
    return _finish_text(text, keys).unionByName(tabled)


def _finish_text(text: DataFrame, keys: list[str]) -> DataFrame:
    locator = F.to_json(
        F.struct(F.lit("text_section").alias("kind"), "page_number", "section_heading"), {"ignoreNullFields": "false"}
    )
    return (
        text.filter(F.col("text_snippet") != "")
        .withColumn("clause_type", clause_type("text_snippet"))
        .withColumn("source_locator", locator)
        .select(*keys, "chunk_index", "page_number", "section_heading", "clause_type", "text_snippet", "source_locator")
    )


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """A repeatable 64-bit id, so a recomputed partition gives the same ids."""
    return chunks.withColumn("chunk_id", F.xxhash64("contract_id", "document_version_hash", "chunk_index"))


def current_documents(parents: DataFrame) -> DataFrame:
    """The newest version of each contract, ties by version hash."""
    return latest(parents, ["contract_id"], ["ingested_at_timestamp", "document_version_hash"])


def chunk_inventory(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count and time range per parent; chunks are counted before the join."""
    counted = chunks.groupBy("parent_id").agg(
        F.count("chunk_id").alias("_chunks"),
        F.min("created_at_timestamp").alias("first_chunk_created_at"),
        F.max("created_at_timestamp").alias("last_chunk_created_at"),
    )
    names = ["contract_id", "contract_name", "offtaker_name", "asset_id", "document_version_hash"]
    return (
        parents.join(counted, "parent_id", "left")
        .groupBy(*names)
        .agg(
            F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunk_count"),
            F.min("first_chunk_created_at").alias("first_chunk_created_at"),
            F.max("last_chunk_created_at").alias("last_chunk_created_at"),
        )
    )


def field_map(text: Column) -> Column:
    """``Field | Value`` lines as a map; the first value of a repeated field stays."""
    rows = F.filter(
        F.transform(F.split(text, LINE_BREAK), lambda line: F.split(line, "\\|")), lambda cells: F.size(cells) == 2
    )
    pairs = F.transform(rows, lambda c: F.struct(strip(c[0]).alias("key"), strip(c[1]).alias("value")))
    named = F.filter(pairs, lambda p: (p["key"] != "") & (p["key"] != "Field"))
    firsts = F.filter(
        let(named, lambda ps: F.transform(ps, lambda p, i: F.struct(
            p["key"].alias("key"), p["value"].alias("value"),
            (F.array_position(F.transform(ps, lambda q: q["key"]), p["key"]) == i + 1).alias("first"),
        ))),
        lambda p: p["first"],
    )
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["key"], p["value"])))


def sentence_value(text: Column, key: str) -> Column:
    """Value of a ``Key: value.`` sentence, or null."""
    return F.nullif(F.regexp_extract(text, key + r": ([^\n]+?)\.(?:\s|$)", 1), F.lit(""))


def extract_metadata(docs: DataFrame, text: str, sentences: dict[str, str]) -> DataFrame:
    """Adds ``fields`` from two-column rows and one column per wanted sentence key."""
    out = docs.withColumn("fields", field_map(F.col(text)))
    return out.withColumns({name: sentence_value(F.col(text), key) for name, key in sentences.items()})


def money(text: Column) -> Column:
    """Number from ``$1,234.50`` or ``$42.50/MWh``; anything else is null."""
    bare = F.regexp_replace(F.regexp_replace(text, "/MWh$", ""), "[$,]", "")
    return strip(bare).try_cast("double")


def extract_line_items(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Typed five-column statement rows, in document order."""
    cells = F.transform(F.split(F.col(text), LINE_BREAK), lambda line: F.transform(F.split(line, "\\|"), strip))
    items = F.filter(cells, lambda c: (F.size(c) == 5) & (F.get(c, F.lit(0)) != "Charge Code"))
    return docs.select(*keys, F.posexplode(items).alias("item_no", "c")).select(
        *keys, "item_no",
        F.col("c")[0].alias("charge_code"), F.col("c")[1].alias("description"),
        F.col("c")[2].try_cast("double").alias("mwh"),
        money(F.col("c")[3]).alias("rate_usd_per_mwh"), money(F.col("c")[4]).alias("amount_usd"),
    )


def registry(docs: DataFrame, text: str = "raw_text_content", at: Column | None = None) -> DataFrame:
    """One row per document: title is its first line, date the first ISO date in the text."""
    first = F.get(text_lines(F.col(text)), F.lit(0))["text"]
    date = F.nullif(F.regexp_extract(F.col(text), r"\b(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return docs.withColumns({
        "document_title": first,
        "event_date": F.try_to_date(date, "yyyy-MM-dd"),
        "processed_at": F.current_timestamp() if at is None else at,
    }).drop(text)


def normalise_numbered(text: Column) -> Column:
    """Squashed ``1. Title`` lines as ``Section 1: Title``, so numbered headings are detected."""
    return F.regexp_replace(squash(text), r"^(\d+(?:\.\d+)*)\.? (?=\p{L})", "Section $1: ")
