"""Queries on contract texts, chunks and similarity search."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from gridledger import fixed_values as fv
from gridledger.functions.scalars import SPACE_CHARS, mime_type, time_text
from gridledger.functions.skew import dealt
from gridledger.operators import documents as ops
from gridledger.operators import retrieval
from gridledger.operators.cases import breach_events
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.session import materialize, shuffles_freed, staged, work_path
from gridledger.sources import merge, sinks

_KEYS = ["document_id"]
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_HEADING = (
    r"^\s*((section|article|exhibit|schedule|appendix)\s+[\p{L}\p{M}\p{N}_\-.]+|\p{Nd}+(\.\p{Nd}+)*\s+)"
    r"[\):.\-\s]+(.{3,120})$"
)


def _lines(spark, sf_dir):
    return ops.to_lines(dealt(t.documents(spark, sf_dir).select("document_id", "raw_text_content")))


def _squash(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'))"


part("lines_all", f"""
SELECT document_id, unnest(list_filter(list_transform(string_split_regex(body, '{_BREAK}'), lambda x: trim(x, '{SPACE_CHARS}')), lambda x: x <> ''))
  AS line, generate_subscripts(list_filter(list_transform(string_split_regex(body, '{_BREAK}'), lambda x: trim(x, '{SPACE_CHARS}')), lambda x: x <> ''), 1) - 1
  AS line_no FROM docs
""", ["docs"])

part("headings", f"""
SELECT document_id, line_no, line, CASE WHEN substr(line, 1, 200) = substr(clean, 1, 200)
    AND (regexp_matches(clean, '{_HEADING}', 'i')
      OR (length(clean) <= 120 AND upper(clean) = clean AND regexp_matches(clean, '\\p{{L}}'))) THEN substr(clean, 1, 200) END AS heading
FROM (SELECT *, {_squash('line')} AS clean FROM lines_all)
""", ["lines_all"])

part("sectioned", """
SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no,
  last_value(heading IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_heading
FROM (SELECT *, CASE WHEN heading IS NOT NULL AND heading IS DISTINCT FROM before THEN 1 ELSE 0 END AS opens FROM (
  SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM headings))
""", ["headings"])

part("sections", """
SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY section_no) - 1 AS section_no, section_heading,
  section_text FROM (
  SELECT document_id, section_no, any_value(section_heading) AS section_heading, string_agg(line, ' ' ORDER BY line_no) AS section_text
  FROM sectioned GROUP BY 1, 2)
""", ["sectioned"])


def _cut(start: str) -> str:
    """SQL for where the part that begins at ``start`` ends."""
    window = f"substr(clean, {start} + 1, least({start} + 1400, n) - {start})"

    def last(mark: str) -> str:
        back = f"strpos(reverse({window}), '{mark[::-1]}')"
        return f"CASE WHEN {back} > 0 THEN length({window}) - 1 - {back} ELSE -1 END"

    mark = f"greatest({last('. ')}, {last('; ')})"
    return f"CASE WHEN {start} + 1400 < n AND {mark} > 770 THEN {start} + {mark} + 1 ELSE least({start} + 1400, n) END"


part("clean_sections", f"""
SELECT document_id, section_no, section_heading, {_squash('section_text')} AS clean, length({_squash('section_text')}) AS n
FROM sections
""", ["sections"])

part("cuts", f"""
SELECT document_id, section_no, section_heading, clean, n, 0 AS part_no, CAST(0 AS BIGINT) AS s, CAST({_cut('0')} AS BIGINT) AS e
FROM clean_sections
UNION ALL
SELECT document_id, section_no, section_heading, clean, n, part_no + 1, s, CAST({_cut('s')} AS BIGINT) FROM (
  SELECT document_id, section_no, section_heading, clean, n, part_no, greatest(e - 200, s + 1) AS s FROM cuts WHERE e < n)
""", ["clean_sections"])


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words)


def clause_sql(text: str) -> str:
    """SQL for the clause class of ``text``."""
    columns = ", ".join(f"{_hits(words)} AS {name}" for name, words in fv.CLAUSE_KEYWORDS.items())
    best = f"greatest({', '.join(fv.CLAUSE_KEYWORDS)})"
    ladder = " ".join(f"WHEN {name} = {best} THEN '{name}'" for name in fv.CLAUSE_KEYWORDS)
    return f"(SELECT CASE WHEN {best} = 0 THEN NULL {ladder} END FROM (SELECT {columns} FROM (SELECT lower({text}) AS low)))"


part("chunks", f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_no, part_no) - 1 AS chunk_index,
  section_heading, trim(substr(clean, s + 1, e - s)) AS text_snippet
FROM cuts
""", ["cuts"])


@query("document_lines", "SELECT document_id, line_no, line FROM lines_all", ["lines_all"])
def document_lines(spark, sf_dir):
    return ops.explode_lines(_lines(spark, sf_dir), _KEYS).select("document_id", "line_no", F.col("text").alias("line"))


@query("section_headings", "SELECT document_id, line_no, heading FROM headings WHERE heading IS NOT NULL", ["headings"])
def section_headings(spark, sf_dir):
    lines = ops.explode_lines(_lines(spark, sf_dir), _KEYS)
    return ops.detect_headings(lines).filter(F.col("heading").isNotNull()).select("document_id", "line_no", "heading")


@query("section_of_line", """
SELECT document_id, line_no, CAST(section_no AS INTEGER) AS section_no, section_heading FROM sectioned
""", ["sectioned"])
def section_of_line(spark, sf_dir):
    lines = ops.explode_lines(_lines(spark, sf_dir), _KEYS)
    return ops.assign_sections(lines, _KEYS).select("document_id", "line_no", "section_no", "section_heading")


@query("document_sections", "SELECT document_id, section_no, section_heading, md5(section_text) AS text_md5 FROM sections", ["sections"])
def document_sections(spark, sf_dir):
    return ops.sections(_lines(spark, sf_dir), _KEYS).select(
        "document_id", "section_no", "section_heading", F.md5("section_text").alias("text_md5")
    )


@query("document_chunks", f"""
SELECT document_id, chunk_index, section_heading, {clause_sql('text_snippet')} AS clause_type, md5(text_snippet) AS text_md5,
  length(text_snippet) AS n_chars FROM chunks WHERE text_snippet <> ''
""", ["chunks"])
def document_chunks(spark, sf_dir):
    return ops.build_chunks(_lines(spark, sf_dir), _KEYS).select(
        "document_id", "chunk_index", "section_heading", "clause_type", F.md5("text_snippet").alias("text_md5"),
        F.length("text_snippet").alias("n_chars"),
    )


@query("window_chunks", """
SELECT doc_id, i AS chunk_index, md5(substr(text, i * 750 + 1, 900)) AS text_md5
FROM (SELECT doc_id, text, unnest(range((length(text) + 749) // 750)) AS i FROM documents)
""")
def window_chunks(spark, sf_dir):
    rows = ops.window_chunks(t.read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return rows.select("doc_id", "chunk_index", F.md5("text_snippet").alias("text_md5"))


@query("page_window_chunks", """
SELECT page_id, i AS chunk_index, md5(substr(html, i * 256 + 1, 512)) AS text_md5
FROM (SELECT page_id, html, unnest(range((length(html) + 255) // 256)) AS i FROM pages)
""")
def page_window_chunks(spark, sf_dir):
    rows = ops.window_chunks(t.read(spark, sf_dir, "pages"), ["page_id"], "html", 512, 256)
    return rows.select("page_id", "chunk_index", F.md5("text_snippet").alias("text_md5"))


@query("clause_types", f"SELECT doc_id, {clause_sql('text')} AS clause_type FROM documents")
def clause_types(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", ops.clause_type("text").alias("clause_type"))


def _tables(spark, sf_dir):
    """Every order line as an extracted table of three cells."""
    texts = (
        F.concat(F.lit("Charge "), F.col("l_partkey").cast("string")),
        F.concat(F.lit("Shipped "), F.col("l_returnflag"), F.col("l_linestatus")),
        F.when(F.col("l_linestatus") == "O", "Invoice open").otherwise("None"),
    )
    cells = F.array(*[
        F.struct(F.lit(0).alias("row"), F.lit(i).alias("column"), text.alias("content")) for i, text in enumerate(texts)
    ])
    return t.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.col("l_linenumber").alias("table_index"), F.lit(1).alias("page_number"), cells.alias("cells"),
    )


@query("table_chunks", f"""
SELECT document_id, table_index, text_snippet, coalesce({clause_sql('text_snippet')}, 'table') AS clause_type FROM (
  SELECT 'T' || l_orderkey AS document_id, l_linenumber AS table_index, 'Charge ' || l_partkey || ' | Shipped ' || l_returnflag || l_linestatus
    || CASE WHEN l_linestatus = 'O' THEN ' | Invoice open' ELSE ' | None' END AS text_snippet FROM lineitem)
""")
def table_chunks(spark, sf_dir):
    return ops.table_chunks(_tables(spark, sf_dir), _KEYS).select("document_id", "table_index", "text_snippet", "clause_type")


def _order_lines(spark, sf_dir):
    """Orders as texts of one or two sections on pages of their own, line by line."""
    def line(no: int, page: int, text):
        return F.struct(F.lit(no).alias("line_no"), F.lit(page).alias("page"), text.alias("text"))

    first = (line(0, 1, F.lit("Section 1.1: Order terms")), line(1, 1, F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is for customer "), F.col("o_custkey").cast("string"), F.lit("."))))
    second = (line(2, 2, F.lit("Section 2.1: Price")), line(3, 2, F.lit("The contract price is fixed.")))
    lines = F.when(F.col("o_orderstatus") == "F", F.array(*first, *second)).otherwise(F.array(*first))
    return t.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("document_id"), F.inline(lines))


def _order_tables(spark, sf_dir):
    """Order lines as tables of their order; those of the second line are blank."""
    def cell(column: int, text):
        return F.struct(F.lit(0).alias("row"), F.lit(column).alias("column"), text.alias("content"))

    number = F.col("l_linenumber").cast("int")
    texts = (F.concat(F.lit("Line "), number.cast("string")), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))
    return t.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("document_id"),
        (number * 1_000_000 + F.col("l_partkey").cast("int")).alias("table_index"), F.lit(3).alias("page_number"),
        F.when(number == 2, F.array(cell(0, F.lit("  ")))).otherwise(F.array(*[cell(i, x) for i, x in enumerate(texts)])).alias("cells"))


@query("document_table_chunks", f"""
SELECT *, coalesce({clause_sql('text_snippet')}, CASE WHEN section_heading = 'TABLE' THEN 'table' END) AS clause_type FROM (
  SELECT 'O' || o_orderkey AS document_id, 0 AS chunk_index, 1 AS page_number, 'Section 1.1: Order terms' AS section_heading,
    'Section 1.1: Order terms Order ' || o_orderkey || ' is for customer ' || o_custkey || '.' AS text_snippet,
    '{{"kind":"text_section","page_number":1,"section_heading":"Section 1.1: Order terms"}}' AS source_locator FROM orders
  UNION ALL
  SELECT 'O' || o_orderkey, 1, 2, 'Section 2.1: Price', 'Section 2.1: Price The contract price is fixed.',
    '{{"kind":"text_section","page_number":2,"section_heading":"Section 2.1: Price"}}' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT 'O' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END
      + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1, 3, 'TABLE',
    'Line ' || l_linenumber || ' | Part ' || l_partkey,
    '{{"kind":"table","page_number":3,"table_index":' || (l_linenumber * 1000000 + l_partkey) || ',"cells":[{{"row":0,"column":0,"content":"Line '
      || l_linenumber || '"}},{{"row":0,"column":1,"content":"Part ' || l_partkey || '"}}]}}'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2)
""")
def document_table_chunks(spark, sf_dir):
    """Text sections by page, then the tables of the document, numbered on."""
    lines = ops.group_lines(_order_lines(spark, sf_dir), _KEYS)
    return ops.build_chunks(lines, _KEYS, _order_tables(spark, sf_dir)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("document_registry", f"""
SELECT document_id, document_type, asset_id, contract_id, 'Section 1.1: Contract Price and Term' AS document_title,
  strftime(TRY_CAST(nullif(regexp_extract(body, '(^|[^0-9A-Za-z_])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 2), '') AS DATE), '%Y-%m-%d') AS text_date
FROM docs
""", ["docs"])
def document_registry(spark, sf_dir):
    return ops.registry(t.documents(spark, sf_dir).drop("event_date")).select(
        "document_id", "document_type", "asset_id", "contract_id", "document_title",
        F.date_format("event_date", "yyyy-MM-dd").alias("text_date"),
    )


def _forms(spark, sf_dir):
    """Orders written out as notice forms and statement rows."""
    text = F.concat(
        F.lit("Settlement notice\nField | Value\nNotice ID | N"), F.col("o_orderkey").cast("string"),
        F.lit("\nReason |  "), F.col("o_orderpriority"), F.lit("\nReason | repeated\nContract ID: src"),
        (F.col("o_custkey") % 20).cast("string"), F.lit(". Region: R1.\nCharge Code | Description | MWh | Rate / Price | Amount\nCURT | Shortfall | "),
        (F.col("o_orderkey") % 100).cast("string"), F.lit(".5 | $"), (F.col("o_custkey") % 50).cast("string"),
        F.lit(".25/MWh | $1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".75\nHOLD | Pending | 1 | N/A | $2.00"),
    )
    return t.read(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw_text_content"))


@query("form_metadata", """
SELECT o_orderkey, 'N' || o_orderkey AS notice_id, o_orderpriority AS reason, 'src' || (o_custkey % 20) AS contract_id,
  'R1' AS region FROM orders
""")
def form_metadata(spark, sf_dir):
    rows = ops.extract_metadata(
        _forms(spark, sf_dir), "raw_text_content", {"contract_id": "Contract ID", "region": "Region"}
    )
    return rows.select(
        "o_orderkey", F.col("fields")["Notice ID"].alias("notice_id"), F.col("fields")["Reason"].alias("reason"),
        "contract_id", "region",
    )


@query("statement_line_items", """
SELECT o_orderkey, 0 AS item_no, 'CURT' AS charge_code, CAST(o_orderkey % 100 + 0.5 AS DOUBLE) AS mwh,
  CAST(o_custkey % 50 + 0.25 AS DOUBLE) AS rate_usd_per_mwh, CAST(1000 + o_orderkey % 1000 + 0.75 AS DOUBLE) AS amount_usd FROM orders
UNION ALL SELECT o_orderkey, 1, 'HOLD', CAST(1 AS DOUBLE), NULL, CAST(2 AS DOUBLE) FROM orders
""")
def statement_line_items(spark, sf_dir):
    return ops.extract_line_items(_forms(spark, sf_dir), ["o_orderkey"], "raw_text_content").drop("description")


# --- versions and inventory --------------------------------------------------------

def _parents(spark, sf_dir):
    return t.documents(spark, sf_dir).select(
        F.concat(F.lit("P"), "document_id").alias("parent_id"), "contract_id",
        F.lit(None).cast("string").alias("contract_name"), F.lit(None).cast("string").alias("offtaker_name"), "asset_id",
        "document_version_hash", F.col("document_id").alias("source_file_name"), "ingested_at_timestamp",
    )


@query("current_documents", """
SELECT contract_id, document_version_hash, document_id AS source_file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY ingested_at DESC, document_version_hash DESC) AS n FROM docs)
WHERE n = 1
""", ["docs"])
def current_documents(spark, sf_dir):
    return ops.current_documents(_parents(spark, sf_dir)).select("contract_id", "document_version_hash", "source_file_name")


@query("chunk_inventory", """
SELECT d.contract_id, d.asset_id, d.document_version_hash, count(c.doc_id) AS chunk_count,
  strftime(min(CASE WHEN c.doc_id IS NOT NULL THEN d.ingested_at END), '%Y-%m-%d %H:%M:%S') AS first_chunk_created_at
FROM docs d LEFT JOIN (SELECT doc_id, unnest(range((length(text) + 749) // 750)) AS i FROM documents) c ON d.doc_id = c.doc_id
GROUP BY 1, 2, 3
""", ["docs"])
def chunk_inventory(spark, sf_dir):
    """Chunks of every text; a parent without text has none and stays."""
    raw = t.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("PDOC"), F.col("doc_id").cast("string")).alias("parent_id"), "text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))).alias(
            "created_at_timestamp"),
    )
    chunks = ops.window_chunks(raw, ["parent_id", "created_at_timestamp"], "text").withColumnRenamed("chunk_index", "chunk_id")
    return ops.chunk_inventory(_parents(spark, sf_dir), chunks).select(
        "contract_id", "asset_id", "document_version_hash", "chunk_count",
        time_text("first_chunk_created_at").alias("first_chunk_created_at"),
    )


@query("upserted_parents", """
SELECT contract_id, document_version_hash, first(parent_id ORDER BY rank_old) AS parent_id,
  first(source_file_name ORDER BY rank_new) AS source_file_name
FROM (
  SELECT contract_id, document_version_hash, 'old' || document_version_hash AS parent_id, 'old' AS source_file_name, 0 AS rank_old, 1 AS rank_new
  FROM (SELECT DISTINCT contract_id, document_version_hash FROM docs WHERE event_date < DATE '2024-01-20')
  UNION ALL
  SELECT contract_id, document_version_hash, parent_id, source_file_name, 1, 0 FROM (
    SELECT *, 'P' || document_id AS parent_id, document_id AS source_file_name,
      row_number() OVER (PARTITION BY contract_id, document_version_hash ORDER BY ingested_at DESC, 'P' || document_id DESC) AS n
    FROM docs WHERE event_date >= DATE '2024-01-10') WHERE n = 1)
GROUP BY 1, 2
""", ["docs"])
def upserted_parents(spark, sf_dir):
    """Texts up to the 19th are the table, texts from the 10th the batch."""
    day = t.documents(spark, sf_dir).select("document_id", "event_date")
    rows = _parents(spark, sf_dir).join(day, F.col("source_file_name") == F.col("document_id"))
    names = _parents(spark, sf_dir).columns
    target = (
        rows.filter(F.col("event_date") < F.lit("2024-01-20").cast("date"))
        .select("contract_id", "document_version_hash").distinct()
        .select(
            F.concat(F.lit("old"), "document_version_hash").alias("parent_id"), "contract_id",
            F.lit(None).cast("string").alias("contract_name"), F.lit(None).cast("string").alias("offtaker_name"),
            F.lit(None).cast("string").alias("asset_id"), "document_version_hash", F.lit("old").alias("source_file_name"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ingested_at_timestamp"),
        )
    )
    batch = rows.filter(F.col("event_date") >= F.lit("2024-01-10").cast("date")).select(*names)
    return merge.upsert_parents(target, batch).select("contract_id", "document_version_hash", "parent_id", "source_file_name")


@query("replaced_children", """
SELECT l_orderkey AS parent_id, l_linenumber AS chunk_no, 'old' AS origin FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'P'
""")
def replaced_children(spark, sf_dir):
    old = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("chunk_no"), F.lit("old").alias("origin")
    )
    new = t.read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("parent_id"), F.lit(0).alias("chunk_no"), F.lit("new").alias("origin")
    )
    return merge.replace_children(old, new)


@query("mime_types", """
SELECT page_id, CASE WHEN lower(url) LIKE '%.txt' THEN 'text/plain' WHEN lower(url) LIKE '%.md' THEN 'text/markdown'
  WHEN lower(url) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(url) LIKE '%.html' OR lower(url) LIKE '%.htm' THEN 'text/html'
  ELSE 'application/octet-stream' END AS mime_type FROM pages
""")
def mime_types(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", mime_type("url").alias("mime_type"))


# --- retrieval ---------------------------------------------------------------------

@query("retrieved_chunks", "SELECT event_id, chunk_id, contract_id, similarity, rank FROM found", ["found"])
def retrieved_chunks(spark, sf_dir):
    found = retrieval.retrieve_context(t.vector_events(spark, sf_dir), t.vector_chunks(spark, sf_dir))
    return found.select("event_id", "chunk_id", "contract_id", "similarity", "rank")


@query("retrieved_curtailment_clauses", t.similarity_sql(5, "c.embedding[1] > 0"))
def retrieved_curtailment_clauses(spark, sf_dir):
    found = retrieval.retrieve_context(
        t.vector_events(spark, sf_dir), t.vector_chunks(spark, sf_dir), k=5, clause="curtailment"
    )
    return found.select("event_id", "chunk_id", "contract_id", "similarity", "rank")


def _versioned_events(spark, sf_dir):
    """Events that name a version; those of contract 9 name one that does not exist."""
    version = F.when(F.col("label") == 9, "gone").otherwise(F.concat(F.lit("v"), F.col("label").cast("string")))
    return t.vector_events(spark, sf_dir).withColumn("document_version_hash", version)


@query("retrieval_quality", """
SELECT 'E' || q.vec_id AS event_id, 'src' || q.label AS contract_id, coalesce(n, 0) AS retrieved_chunk_count,
  top AS top_similarity_score, round(mean, 7) AS average_similarity_score, n IS NULL AS no_evidence_flag,
  n IS NOT NULL AND q.label = 8 AS wrong_contract_blocked_flag
FROM embeddings q LEFT JOIN (SELECT event_id, count(*) AS n, max(similarity) AS top, avg(similarity) AS mean
  FROM found WHERE contract_id <> 'src9' GROUP BY 1) ON event_id = 'E' || q.vec_id
""", ["found"])
def retrieval_quality(spark, sf_dir):
    """Events of contract 8 come with a best chunk that another contract owns, as a faulty store would give."""
    events = _versioned_events(spark, sf_dir)
    found = retrieval.retrieve_context(events, t.vector_chunks(spark, sf_dir)).withColumn(
        "contract_id", F.when((F.col("contract_id") == "src8") & (F.col("rank") == 1), "src0").otherwise(F.col("contract_id")))
    return retrieval.retrieval_quality(events, found).withColumn(
        "average_similarity_score", F.round("average_similarity_score", 7)
    ).drop("document_version_hash")


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL for a fixed text with SQL expressions in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts) if x)


part("breach_queries", f"""
SELECT breach_event_id AS event_id, fact_record_hash, contract_id, {_filled(fv.RETRIEVAL_QUERY, {
    "event_type": f"'{fv.DEFAULT_EVENT_TYPE}'", "contract_id": "associated_ppa_id", "asset_id": "asset_id",
    "iso_region": "iso_region", "leakage": "CAST(round(leakage_usd, 2) AS VARCHAR)"})} AS query_text FROM breaches
""", ["breaches"])


def _breach_queries(spark, sf_dir):
    rows = breach_events(t.gold_fact(spark, sf_dir)).withColumn(
        "estimated_leakage_revenue_usd", F.round("estimated_leakage_revenue_usd", 2))
    return retrieval.retrieval_query(rows)


@query("retrieval_queries", "SELECT fact_record_hash, query_text FROM breach_queries", ["breach_queries"])
def retrieval_queries(spark, sf_dir):
    return _breach_queries(spark, sf_dir).select("fact_record_hash", "query_text")


@query("evidence_prompts", """
SELECT event_id, string_agg('CHUNK_ID: ' || chunk_id || chr(10) || 'CONTRACT_ID: ' || contract_id || chr(10) || 'PAGE: 1' || chr(10)
  || 'SECTION: Terms' || chr(10) || 'CLAUSE_TYPE: ' || CASE WHEN e.embedding[1] > 0 THEN 'curtailment' ELSE 'notice' END || chr(10)
  || 'SIMILARITY: ' || CASE WHEN similarity > 0 THEN 'positive' ELSE 'other' END || chr(10) || 'TEXT: chunk ' || chunk_id,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS prompt
FROM found JOIN embeddings e ON e.vec_id = chunk_id GROUP BY 1
""", ["found"])
def evidence_prompts(spark, sf_dir):
    found = retrieval.retrieve_context(t.vector_events(spark, sf_dir), t.vector_chunks(spark, sf_dir))
    packs = retrieval.evidence_array(found)
    # The number itself is written by another engine's rules, so only its sign is compared.
    prompt = F.regexp_replace(retrieval.evidence_prompt(F.col("evidence")), r"SIMILARITY: (0\.0\n|-[^\n]*\n)", "SIMILARITY: other\n")
    prompt = F.regexp_replace(prompt, r"SIMILARITY: [0-9][^\n]*", "SIMILARITY: positive")
    return packs.select("event_id", prompt.alias("prompt"))


_CACHE_KEY = (
    """'rag:' || sha256('{"clause_type":null,"contract_id":"src' || label || '","document_version_hash":null,"embedding_model":"'"""
    f""" || '{fv.EMBEDDING_MODEL}","query":"E' || vec_id || '","retrieval_version":"{fv.RETRIEVAL_VERSION}"}}')""")


part("places", """
SELECT vec_id, label, places FROM embeddings JOIN (
  SELECT event_id, string_agg(chunk_id || ' chunk ' || chunk_id, ',' ORDER BY rank) AS places FROM found GROUP BY 1) ON event_id = 'E' || vec_id
""", ["found"])


@query("cached_retrieval", f"""
SELECT 'answer' AS part, 'E' || vec_id AS name, label < 5 AS cache_hit, places, NULL AS cached_at FROM places
UNION ALL
SELECT 'addition', {_CACHE_KEY}, NULL, places, '2024-02-01 12:00:00' FROM places WHERE label >= 5
""", ["places"])
def cached_retrieval(spark, sf_dir):
    """Answers for contracts 0 to 4 are cached, those for the others are too old and are cached again."""
    now = dt.datetime(2024, 2, 1, 12, 0, 0)
    events = t.vector_events(spark, sf_dir).withColumn("query_text", F.col("event_id"))
    chunks = t.vector_chunks(spark, sf_dir)
    known = materialize(retrieval.evidence_array(retrieval.retrieve_context(events, chunks)), "evidence")
    age = F.when(F.col("label") < 5, 600).otherwise(7200)
    cache = events.join(known, "event_id").select(
        retrieval.cache_key().alias("cache_key"),
        (F.lit(now) - F.make_dt_interval(secs=age.cast("decimal(18,6)"))).alias("cached_at"), "evidence",
    )
    answered, added = retrieval.cached_retrieve(events, chunks, cache, now)
    places = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["chunk_index"], e["text_snippet"])), ",").alias("places")
    return answered.select(
        F.lit("answer").alias("part"), F.col("event_id").alias("name"), "cache_hit", places, F.lit(None).cast("string").alias("cached_at"),
    ).unionByName(added.select(
        F.lit("addition").alias("part"), F.col("cache_key").alias("name"), F.lit(None).cast("boolean").alias("cache_hit"), places,
        time_text("cached_at").alias("cached_at")))


def _hashed(keys: str, text: str, source: str) -> str:
    """SQL for signed token hashes of unit length, as ``vec`` beside the keys."""
    size = retrieval.HASH_DIMENSIONS
    return f"""
SELECT {keys}, list((v / norm)::FLOAT::DOUBLE ORDER BY place) AS vec FROM (
  SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS norm FROM (
    SELECT {keys}, place, coalesce(sum(CASE WHEN hit = place THEN sign END), 0)::DOUBLE AS v FROM (
      SELECT {keys}, ('0x' || substr(digest, 1, 8))::BIGINT % {size} AS hit, CASE WHEN substr(digest, 9, 1) >= '8' THEN 1 ELSE -1 END AS sign
      FROM (SELECT {keys}, md5(unnest(list_filter(string_split_regex(lower({text}), '{retrieval.TOKEN_SPACE}'), lambda x: x <> ''))) AS digest
        FROM {source})), (SELECT unnest(range({size})) AS place)
    GROUP BY {keys}, place)) GROUP BY {keys}"""


part("chunk_vectors", _hashed("document_id, chunk_index", "text_snippet", "chunks") , ["chunks"])


@query("embedded_chunks", """
SELECT document_id, chunk_index, len(vec) AS dimensions, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 4) AS norm,
  round(list_sum(list_transform(vec, lambda x, i: x * i)), 4) AS weighted,
  array_to_string(list_transform(vec, lambda x: CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END), '') AS signs FROM chunk_vectors
""", ["chunk_vectors"])
def embedded_chunks(spark, sf_dir):
    """Chunk vectors from the hashing embedder, compared by sign at every place, by length and by a weighted sum."""
    chunks = ops.build_chunks(_lines(spark, sf_dir), _KEYS).select("document_id", "chunk_index", "text_snippet")
    rows = retrieval.embed(chunks, "text_snippet", "embedding_vector")
    wide = F.transform("embedding_vector", lambda x: x.cast("double"))
    norm = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)
    weighted = F.aggregate(F.transform(wide, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    signs = F.transform(wide, lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0"))
    return rows.select(
        "document_id", "chunk_index", F.size("embedding_vector").alias("dimensions"), F.round(F.sqrt(norm), 4).alias("norm"),
        F.round(weighted, 4).alias("weighted"), F.array_join(signs, "").alias("signs"))


def contract_chunks(spark, sf_dir):
    """Chunks of all contract texts with ids."""
    docs = t.documents(spark, sf_dir).select("contract_id", "document_version_hash", "document_id", "raw_text_content")
    # Copies of one text in one contract are one version.
    firsts = docs.groupBy("contract_id", "document_version_hash").agg(F.min("document_id").alias("document_id"))
    # Texts move once: the join, which is not to be a broadcast, deals them to the tasks.
    versions = docs.join(firsts.select("document_id").hint("shuffle_hash"), "document_id", "left_semi")
    return ops.with_chunk_id(ops.build_chunks(ops.to_lines(versions), ["contract_id", "document_version_hash"]))


part("contract_chunks", """
SELECT contract_id, document_version_hash, c.chunk_index, text_snippet, vec FROM (
  SELECT contract_id, document_version_hash, min(document_id) AS document_id FROM docs GROUP BY 1, 2)
JOIN chunks c USING (document_id) JOIN chunk_vectors v USING (document_id, chunk_index)
""", ["docs", "chunks", "chunk_vectors"])

part("query_vectors", _hashed("event_id, contract_id", "query_text", "breach_queries"), ["breach_queries"])


@query("breach_context", f"""
SELECT * FROM (
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY similarity DESC, chunk_index, document_version_hash) AS rank,
    contract_id, document_version_hash, chunk_index, {clause_sql('text_snippet')} AS clause_type, similarity
  FROM (SELECT q.event_id, q.contract_id, c.document_version_hash, c.chunk_index, c.text_snippet,
      round(list_cosine_similarity(q.vec, c.vec), 9) AS similarity
    FROM query_vectors q JOIN contract_chunks c ON q.contract_id = c.contract_id)) WHERE rank <= {fv.RETRIEVAL_TOP_K}
""", ["query_vectors", "contract_chunks"])
def breach_context(spark, sf_dir):
    """Contract text for every breach: embedded query against the embedded chunks of its contract."""
    events = _breach_queries(spark, sf_dir).select(
        F.col("breach_event_id").alias("event_id"), "contract_id", F.lit(None).cast("string").alias("document_version_hash"),
        "query_text",
    )
    path = work_path(spark, "chunks")
    with shuffles_freed(spark):
        events = materialize(retrieval.embed(dealt(events), "query_text", "query_vector"), "events")
        # Stored first: finding the ranges would cut all texts once more.
        with staged(contract_chunks(spark, sf_dir), "unsorted") as unsorted:
            sinks.write_clustered(unsorted, path, ["contract_id", "chunk_index"],
                                  finish=lambda rows: retrieval.embed(rows, "text_snippet", "embedding_vector"))
    chunks = spark.read.parquet(path)
    return retrieval.retrieve_context(events, chunks).select(
        "event_id", "rank", "contract_id", "document_version_hash", "chunk_index", "clause_type", "similarity"
    )
