import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridledger import fixed_values as fv
from gridledger.functions.scalars import clause_type, float_text, heading_candidate, json_text, squash
from gridledger.operators import documents, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("line,heading", [
    ("Section 4.2 - Curtailment and Price", "Section 4.2 - Curtailment and Price"),
    ("ARTICLE IV: Payment terms", "ARTICLE IV: Payment terms"),
    ("7 - Billing", "7 - Billing"),
    ("1. Agreement Summary", None),
    ("SCHEDULE", "SCHEDULE"),
    ("123 456", None),
    ("A" * 121, None),
    ("Plain text here", None),
    ("TWO  BLANKS", None),
    ("ÉNERGIE", "ÉNERGIE"),
    ("section 1 ab", None),
])
def test_headings(spark, line, heading):
    assert one(spark, heading_candidate(F.lit(line))) == heading


def test_numbered_headings_can_be_normalised(spark):
    text = one(spark, documents.normalise_numbered(F.lit("1. Agreement Summary")))
    assert one(spark, heading_candidate(F.lit(text))) == "Section 1: Agreement Summary"


def test_squash_handles_every_kind_of_space(spark):
    assert one(spark, squash(F.lit(" a\t\tb  c\nd  e\x1f"))) == "a b c d e"
    assert one(spark, squash(F.lit("a b"))) == "a b"


@pytest.mark.parametrize("text,kind", [
    ("The party shall generate", "price"), ("capacity", "limitation"), ("nothing here", None), ("Invoice payment and a notice", "settlement"),
    ("curtailment", "curtailment"), ("price and notice", "price"), ("", None),
])
def test_clause_types(spark, text, kind):
    assert one(spark, clause_type(F.lit(text))) == kind


def brute_parts(text, size=1400, overlap=200):
    """Cut positions found by looking at every allowed mark."""
    clean = " ".join(text.split())
    if len(clean) <= size:
        return [clean]
    parts, at = [], 0
    while True:
        stop = min(at + size, len(clean))
        if stop < len(clean):
            marks = [i for i in range(at + int(size * 0.55) + 1, stop - 1) if clean[i:i + 2] in (". ", "; ")]
            if marks:
                stop = marks[-1] + 1
        parts.append(clean[at:stop].strip())
        if stop == len(clean):
            return parts
        at = max(stop - overlap, at + 1)


def random_text(seed, words):
    rng = random.Random(seed)
    return "".join(rng.choice(["mot", "énergie", "a", "pay", " "]) + rng.choice([" ", " ", " ", ". ", "; ", "\n", "  "]) for _ in range(words))


def test_parts_of_long_texts(spark):
    texts = [random_text(i, n) for i, n in enumerate([0, 1, 50, 300, 900, 5000, 20000])] + ["x" * 5000, "a. " * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.p for r in rows.select("id", documents.split_text(F.col("text")).alias("p")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_parts(text), i


def test_small_part_sizes(spark):
    text = random_text(9, 400)
    assert one(spark, documents.split_text(F.lit(text), 50, 10)) == brute_parts(text, 50, 10)


def test_windows_cover_the_whole_text(spark):
    text = random_text(3, 40000)
    got = one(spark, documents.window_array(F.lit(text)))
    assert got == [text[s:s + 900] for s in range(0, len(text), 750)]
    assert one(spark, documents.window_array(F.lit(""))) == []


CONTRACT = """Synthetic agreement

SYNTHETIC SAMPLE ONLY
  Facility: north.
Section 2.1 - Price and rate
Buyer pays $42.50 per MWh.
Section 2.1 - Price and rate
Repeated heading goes on.
SCHEDULE A
Notice of claims."""


def test_sections_inherit_and_repeat(spark):
    rows = spark.createDataFrame([("D", CONTRACT)], "document_id string, raw_text_content string")
    lines = documents.to_lines(rows)
    out = documents.sections(lines, ["document_id"]).orderBy("section_no").collect()
    assert [(r.section_heading, r.section_text) for r in out] == [
        (None, "Synthetic agreement"),
        ("SYNTHETIC SAMPLE ONLY", "SYNTHETIC SAMPLE ONLY Facility: north."),
        ("Section 2.1 - Price and rate", "Section 2.1 - Price and rate Buyer pays $42.50 per MWh. Section 2.1 - Price and rate Repeated heading goes on."),
        ("SCHEDULE A", "SCHEDULE A Notice of claims."),
    ]
    by_line = documents.assign_sections(documents.explode_lines(lines, ["document_id"]), ["document_id"])
    assert [r.section_no for r in by_line.orderBy("line_no").collect()] == [0, 1, 1, 2, 2, 2, 2, 3, 3]


def test_empty_document_has_no_chunks(spark):
    rows = spark.createDataFrame([("D", " \n\t\n")], "document_id string, raw_text_content string")
    assert documents.build_chunks(documents.to_lines(rows), ["document_id"]).count() == 0


def test_tables_follow_the_text_and_pages_are_kept(spark):
    lines = spark.createDataFrame([("D", 1, 2, "Second line"), ("D", 0, 1, "PRICE TERMS"), ("D", 2, 3, "NOTICE")],
                                  "document_id string, line_no int, page int, text string")
    tables = spark.createDataFrame(
        [("D", 1, 4, [(0, 0, "Rate"), (0, 1, "42.50")]), ("D", 0, 4, [(0, 0, "x"), (0, 1, "y")]), ("D", 2, 4, [(0, 0, " ")])],
        "document_id string, table_index int, page_number int, cells array<struct<row:int,column:int,content:string>>")
    out = documents.build_chunks(documents.group_lines(lines, ["document_id"]), ["document_id"], tables).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_number, r.section_heading, r.clause_type) for r in out] == [
        (0, 1, "PRICE TERMS", "price"), (1, 3, "NOTICE", "notice"), (2, 4, "TABLE", "table"), (3, 4, "TABLE", "price")]
    assert out[3].text_snippet == "Rate | 42.50" and '"kind":"table"' in out[3].source_locator
    assert '"section_heading":"NOTICE"' in out[1].source_locator


def test_notice_metadata_and_line_items(spark):
    text = ("Notice\nField | Value\nNotice ID | N-14\nIssue Time UTC | 2026-06-23T19:15:00Z\nExpected Available MW | 64.8\n"
            "Statement ID: S-1. Market: M.\nCharge Code | Description | MWh | Rate / Price | Amount\n"
            "MTR_ENERGY | Metered | 20.3 | $31.22/MWh | $1,633.77\nDISPUTE_HOLD | Pending | 14.117 | N/A | $547.03")
    rows = spark.createDataFrame([("D", text)], "document_id string, t string")
    row = documents.extract_metadata(rows, "t", {"statement_id": "Statement ID", "none": "Absent"}).first()
    assert row.fields == {"Notice ID": "N-14", "Issue Time UTC": "2026-06-23T19:15:00Z", "Expected Available MW": "64.8"}
    assert row.statement_id == "S-1" and row.none is None
    items = documents.extract_line_items(rows, ["document_id"], "t").orderBy("item_no").collect()
    assert [(i.charge_code, i.mwh, i.rate_usd_per_mwh, i.amount_usd) for i in items] == [
        ("MTR_ENERGY", 20.3, 31.22, 1633.77), ("DISPUTE_HOLD", 14.117, None, 547.03)]


def test_chunk_ids_repeat(spark):
    rows = spark.createDataFrame([("C", "v", 0), ("C", "v", 1)], "contract_id string, document_version_hash string, chunk_index int")
    first = [r.chunk_id for r in documents.with_chunk_id(rows).collect()]
    assert first == [r.chunk_id for r in documents.with_chunk_id(rows).collect()] and len(set(first)) == 2


@pytest.mark.parametrize("value,text", [(751.19, "751.19"), (12345678.5, "12345678.5"), (0.0, "0.0"), (1e7, "10000000.0"), (0.0005, "0.0005"), (-2e8, "-200000000.0")])
def test_number_text(spark, value, text):
    assert one(spark, float_text(F.lit(value))) == text


def test_json_text(spark):
    import json

    value = 'a "b" \\ c\nd\te'
    assert json.loads(one(spark, json_text(F.lit(value)))) == value
    assert one(spark, json_text(F.lit(None).cast("string"))) == "null"


# --- retrieval ------------------------------------------------------------------------

def vectors(spark, rows, names):
    return spark.createDataFrame(rows, names)


EVENT = "event_id string, contract_id string, document_version_hash string, query_vector array<float>"
CHUNK = "chunk_id long, contract_id string, document_version_hash string, clause_type string, embedding_vector array<float>, chunk_index int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    contracts = ["hot"] * 10 + ["a", "b", "c"]
    chunks = [(i, contracts[i % 13], f"v{i % 2}", "price" if i % 3 else "notice", rng.integers(-2, 3, 6).astype(float).tolist(), i) for i in range(400)]
    events = [(f"e{i}", contracts[(i * 7) % 13], None if i % 2 else "v1", rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(120)]
    return chunks, events


def brute(chunks, events, k, clause=None):
    out = {}
    for eid, contract, version, q in events:
        scored = []
        for cid, c, v, kind, x, _ in chunks:
            if c != contract or (version and v != version) or (clause and kind != clause):
                continue
            norm = np.linalg.norm(q) * np.linalg.norm(x)
            scored.append((-round(float(np.dot(q, x) / norm), 9) if norm > 0 else 2.0, cid))
        out[eid] = [cid for _, cid in sorted(scored)[:k]]
    return {e: ids for e, ids in out.items() if ids}


@pytest.mark.parametrize("block", [7, 64, 8192])
@pytest.mark.parametrize("clause", [None, "notice"])
def test_search_is_exact_for_any_block_size(spark, corpus, block, clause):
    chunks, events = corpus
    found = retrieval.retrieve(vectors(spark, events, EVENT), vectors(spark, chunks, CHUNK), 6, clause, block)
    got = {}
    for r in found.orderBy("event_id", "rank").collect():
        got.setdefault(r.event_id, []).append(r.chunk_id)
    assert got == brute(chunks, events, 6, clause)


def test_zero_vectors_rank_last_without_similarity(spark):
    chunks = [(1, "C", "v", "price", [0.0, 0.0], 1), (2, "C", "v", "price", [-1.0, 0.0], 2), (3, "C", "v", "price", [1.0, 0.0], 3)]
    found = retrieval.retrieve(vectors(spark, [("e", "C", None, [1.0, 0.0])], EVENT), vectors(spark, chunks, CHUNK)).orderBy("rank").collect()
    assert [(r.chunk_id, r.similarity) for r in found] == [(3, 1.0), (2, -1.0), (1, None)]


def brute_search(queries, vectors, k, wanted, have):
    found = []
    for i, q in enumerate(queries):
        scored = []
        for j, v in enumerate(vectors):
            if wanted[i] in (-1, have[j]):
                norm = np.linalg.norm(q) * np.linalg.norm(v)
                scored.append((-round(float(q @ v / norm), 9) if norm > 0 else 2.0, j))
        found += [(i, j, -s) for s, j in sorted(scored)[:k]]
    return found


@pytest.mark.parametrize("kind", ["clustered", "random", "equal", "zero"])
def test_pruned_search_equals_brute_force(kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = {
        "clustered": np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 16)) * 0.02, "random": rng.integers(-1, 2, (720, 16)).astype(float),
        "equal": np.ones((720, 16)), "zero": np.zeros((720, 16))}[kind]
    vectors[rng.choice(720, 20)] = 0.0
    queries = np.vstack([vectors[::9] + (0.001 if kind == "clustered" else 0.0), np.zeros((2, 16))])
    have = rng.integers(0, 3, 720)
    wanted = rng.integers(-1, 4, len(queries))
    row, place, value, compared = retrieval.search(queries, vectors, 5, wanted, have, size=40)
    expected = brute_search(queries, vectors, 5, wanted, have)
    assert list(zip(row.tolist(), place.tolist())) == [(i, j) for i, j, _ in expected]
    assert np.allclose(value, [v for _, _, v in expected], atol=2e-9)
    share = compared.sum() / (len(queries) * len(vectors))
    assert share < 0.5 if kind == "clustered" else share <= 1.0


def test_search_tells_what_it_skipped(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8))
    chunks = [(i, "C", "v", "price", (centres[i % 30] + rng.normal(size=8) * 0.01).tolist(), i) for i in range(3000)]
    events = [(f"e{i}", "C", None, centres[i].tolist()) for i in range(30)]
    found = retrieval.retrieve(vectors(spark, events, EVENT), vectors(spark, chunks, CHUNK), 4, effort=True).collect()
    assert len(found) == 120 and all(r.held == 3000 for r in found) and sum(r.compared for r in found) < 0.5 * 120 * 3000


def test_feature_hash_equals_a_plain_one(spark):
    import hashlib

    texts = ["The price is fixed", "a  a\tb\n", "", None, "É ß 漢字 The the", " x" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.v for r in retrieval.embed(rows, "text", "v").collect()}
    for i, text in enumerate(texts):
        sums = np.zeros(64)
        for token in (t for t in re.split(r"[\t-\r ]+", (text or "").lower()) if t):
            digest = hashlib.md5(token.encode()).hexdigest()
            sums[int(digest[:8], 16) % 64] += 1 if digest[8] >= "8" else -1
        norm = np.sqrt((sums ** 2).sum())
        assert got[i] == (sums / norm if norm else sums).astype(np.float32).tolist()


def test_chunks_without_version_keep_their_text(spark):
    chunks = spark.createDataFrame(
        [(1, "C", None, "price", [1.0, 0.0], 0, "first"), (1, "C", "v", "price", [0.0, 1.0], 0, "second")], CHUNK + ", text_snippet string")
    found = retrieval.retrieve_context(vectors(spark, [("e", "C", None, [1.0, 0.1])], EVENT), chunks).orderBy("rank").collect()
    assert [(r.document_version_hash, r.text_snippet) for r in found] == [(None, "first"), ("v", "second")]


def test_jvm_cosine_agrees(spark):
    from gridledger.functions.scalars import cosine_similarity

    assert one(spark, cosine_similarity(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0)))) == pytest.approx(0.8)
    assert one(spark, cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_embedding_is_batched_and_repeatable(spark):
    sizes = spark.sparkContext.accumulator(0)

    def embedder(texts):
        sizes.add(1)
        assert len(texts) <= 64
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(300).select(F.col("id").cast("string").alias("text")).coalesce(1)
    out = retrieval.embed(rows, "text", "vec", embedder).collect()
    assert len(out) == 300 and all(r.vec == [float(len(r.text)), 1.0] for r in out) and sizes.value == 5


def test_query_text_of_an_event(spark):
    rows = spark.createDataFrame([("C", "W", None, 12345678.0)], "contract_id string, asset_id string, iso_region string, estimated_leakage_revenue_usd double")
    text = retrieval.retrieval_query(rows).first().query_text
    assert text.startswith("Find PPA clauses for curtailment settlement variance. Contract: C. Asset: W. ISO region: None. Revenue variance from Gold table: 12345678.0. ")


def test_cache_key_depends_on_every_part(spark):
    base = spark.createDataFrame([("C", None, "q"), ("C", "v", "q"), ("D", None, "q"), ("C", None, "r")],
                                 "contract_id string, document_version_hash string, query_text string")
    keys = {r[0] for r in base.select(retrieval.cache_key()).collect()} | {r[0] for r in base.limit(1).select(retrieval.cache_key("price")).collect()}
    assert len(keys) == 5 and all(re.fullmatch(r"rag:[0-9a-f]{64}", k) for k in keys)


def test_heading_limits_are_fixed_values():
    assert (fv.HEADING_MAX_CHARS, fv.CAPS_HEADING_MAX_CHARS) == (200, 120)


def test_token_hashes_are_summed_once_and_texts_dealt_out(spark):
    """One step per token, not one per token and place; texts of a file that is read whole reach many tasks."""
    from gridledger.functions.skew import dealt
    from gridledger.plans import documents as plans

    rows = spark.range(400).coalesce(1).selectExpr("concat('d', id) AS document_id", "concat('Text of ', id) AS raw_text_content")
    # Adaptive execution would merge parts as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dealt(rows).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(dealt(rows).collect()) == sorted(rows.collect())
    plan = retrieval.embed(rows, "raw_text_content", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.lower()
    assert "RepartitionByExpression" in plans._lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert retrieval.embed(rows.limit(0), "raw_text_content", "v").count() == 0


def test_a_block_goes_through_its_chunks_in_order_and_holds_what_it_found(spark):
    """Runs of chunks of any length give the best of all; ties stay with the lower index, then the lower version."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    kinds = {"event_id": pa.string(), "contract_id": pa.string(), "document_version_hash": pa.string(), "is_chunk": pa.bool_(),
             "chunk_index": pa.int64(), "chunk_id": pa.int64(), "vector": pa.list_(pa.float32())}
    chunks = [(None, "C", f"v{i % 3}", True, i // 3, i, None if i % 50 == 0 else rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(300)]
    events = [(f"e{i}", "C", ["v1", "v9", None, None][i % 4], False, None, None, None if i == 7 else rng.integers(-1, 2, 4).astype(float).tolist())
              for i in range(40)]
    expected = {}
    for e in events:
        scored = []
        for c in chunks:
            if e[2] in (None, c[2]):
                q, x = (np.zeros(4) if v is None else np.array(v) for v in (e[6], c[6]))
                norm = np.linalg.norm(q) * np.linalg.norm(x)
                scored.append((-round(float(q @ x / norm), 9) if norm > 0 else 2.0, c[5]))
        expected[e[0]] = [i for _, i in sorted(scored)[:5]]

    def batches(rows, size):
        for start in range(0, len(rows), size):
            columns = zip(*rows[start:start + size])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    for size, searched in ((7, 1), (13, 20), (64, 100), (1000, 1000)):
        got = {}
        for batch in retrieval._block_top_k(5, searched)(batches(events + chunks, size)):
            for row in batch.to_pylist():
                got.setdefault(row["event_id"], []).append(row["chunk_id"])
                assert row["held"] == 300 and 0 < row["compared"] <= 300 and row["contract_id"] == "C"
        assert got == {e: ids for e, ids in expected.items() if ids}
    assert list(retrieval._block_top_k(5)(batches(chunks, 50))) == [] and list(retrieval._block_top_k(5)(batches(events, 9))) == []
    with pytest.raises(ValueError, match="before the chunks"):
        list(retrieval._block_top_k(5, 10)(batches(events + chunks + events, 5)))


def test_what_an_event_found_is_not_sent_once_per_run_of_chunks(spark):
    """With as many events as chunks of a contract, no event is repeated for each 8,192 chunks."""
    rng = np.random.default_rng(2)
    chunks = [(i, "C", "v", "price", rng.normal(size=4).tolist(), i) for i in range(20000)]
    events = [(f"e{i}", "C", None, rng.normal(size=4).tolist()) for i in range(3000)]
    found = retrieval.retrieve(vectors(spark, events, EVENT), vectors(spark, chunks, CHUNK), 2, effort=True).cache()
    assert found.count() == 6000 and found.agg(F.min("held")).first()[0] == 20000
    few = retrieval.retrieve(vectors(spark, events[:4], EVENT), vectors(spark, chunks, CHUNK), 2, effort=True)
    # A contract with few events is gone through by several tasks.
    assert few.agg(F.max("held")).first()[0] < 20000
    whole = {(r.event_id, r.rank): r.chunk_id for r in found.filter("event_id IN ('e0', 'e1', 'e2', 'e3')").collect()}
    assert {(r.event_id, r.rank): r.chunk_id for r in few.collect()} == whole


def test_breach_context_moves_texts_once_and_keeps_no_unsorted_copy(spark, monkeypatch):
    import os

    from gridledger.plans import documents as plans
    from gridledger.session import shuffles_freed, work_path, work_root

    # Two texts twice in one contract; a copy in another contract is a version of its own.
    rows = [(i, f"Text {i % 4}. " * 200, "en", f"src{i % 2}") for i in range(4)] + [(9, "Text 0. " * 200, "en", "src0"), (5, "Text 1. " * 200, "en", "src0"), (6, None, "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(plans.t, "read", lambda spark, sf_dir, name: docs)
    chunks = plans.contract_chunks(spark, "none")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    # One exchange groups versions, one deals their ids and one the texts.
    assert "REPARTITION" not in plan and sum("Exchange" in line for line in plan.splitlines()) == 3
    assert {(r.contract_id, r.document_version_hash) for r in chunks.collect()} == {
        (r.contract_id, r.document_version_hash) for r in plans.t.documents(spark, "none").collect() if r.document_version_hash}
    path, before = work_path(spark, "clustered"), set(os.listdir(work_root(spark)))
    with shuffles_freed(spark):
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
        with plans.staged(chunks, "unsorted") as unsorted:
            plans.sinks.write_clustered(unsorted, path, ["contract_id", "chunk_index"],
                                        finish=lambda x: retrieval.embed(x, "text_snippet", "embedding_vector"))
    table = spark.read.parquet(path)
    assert table.count() == chunks.count() and table.filter("size(embedding_vector) != 64").isEmpty()
    assert set(os.listdir(work_root(spark))) - before == {os.path.basename(path)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_equal_questions_of_a_block_are_asked_once(monkeypatch):
    import pyarrow as pa

    asked, plain = [], retrieval.search
    monkeypatch.setattr(retrieval, "search", lambda queries, *rest, **more: asked.append(len(queries)) or plain(queries, *rest, **more))
    events = pa.RecordBatch.from_pylist([
        {"event_id": f"e{i}", "contract_id": "C", "document_version_hash": None if i % 3 else "v", "is_chunk": False, "chunk_index": None,
         "chunk_id": None, "vector": [float(i % 2), 1.0]} for i in range(60)])
    chunks = pa.RecordBatch.from_pylist([
        {"event_id": None, "contract_id": "C", "document_version_hash": "v" if i % 2 else "w", "is_chunk": True, "chunk_index": i,
         "chunk_id": i, "vector": [float(i % 5), 1.0]} for i in range(40)], schema=events.schema.set(
             events.schema.get_field_index("chunk_index"), pa.field("chunk_index", pa.int64())).set(
             events.schema.get_field_index("chunk_id"), pa.field("chunk_id", pa.int64())))
    found = [row for batch in retrieval._block_top_k(2)(iter([events.cast(chunks.schema), chunks])) for row in batch.to_pylist()]
    assert asked == [4] and len(found) == 120
    best = {}
    for row in found:
        best.setdefault(row["event_id"], []).append(row["chunk_id"])
    assert best["e1"] == [1, 6] and best["e2"] == [0, 5] and best["e3"] == [1, 11] and best["e0"] == [5, 15] and best["e7"] == best["e1"]
