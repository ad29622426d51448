import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.profiles import EVIDENCE_TYPE, NOTICE_SCHEMA, text_schema, zone_path
from gridledger.session import materialize, work_path, work_root
from gridledger.sources import files, kafka, merge, sinks


def test_snapshot_scan_and_landing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ASSET_ID,RATED_CAPACITY_MW\nW,161.0\nS,482.0\n")
    schema = text_schema("ASSET_ID", "RATED_CAPACITY_MW")
    assert files.scan_csv(spark, str(tmp_path / "a.csv"), schema).columns == ["asset_id", "rated_capacity_mw"]
    files.land_snapshot(spark, str(tmp_path / "a.csv"), str(tmp_path / "landed"), schema)
    assert sorted(r.asset_id for r in spark.read.parquet(str(tmp_path / "landed")).collect()) == ["S", "W"]


def test_snapshot_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("B,A\n1,2\n")
    with pytest.raises(Exception, match="header|Header"):
        files.scan_csv(spark, str(tmp_path / "a.csv"), text_schema("A", "B")).collect()


def test_registered_table(spark):
    spark.sql("DROP TABLE IF EXISTS default.case_results_demo")
    sinks.register(spark.range(3), "default.case_results_demo")
    assert spark.table("default.case_results_demo").count() == 3
    spark.sql("DROP TABLE default.case_results_demo")


def test_clustered_table_splits_a_hot_contract(spark, tmp_path):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("contract_id"), "id")
    path = str(tmp_path / "c")
    sinks.write_clustered(rows, path, ["contract_id", "id"], ranges=8)
    table = spark.read.parquet(path)
    assert table.count() == 9000
    files_of_hot = table.filter("contract_id = 'hot'").select("_metadata.file_name").distinct().count()
    assert 1 < files_of_hot < table.select("_metadata.file_name").distinct().count()


def test_outcomes_are_written_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "UNKNOWN_ASSET")], "id int, validation_error_code string")
    sinks.write_outcomes(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "outcome=valid")).first().id == 1
    assert spark.read.parquet(str(tmp_path / "o" / "outcome=quarantine")).first().id == 2


def test_manifest_lands_every_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id\n1\n")
    (tmp_path / "two.csv").write_text("id\n2\n3\n")
    manifest = {"extract_id": "x", "extract_timestamp_utc": "t", "source_systems": [
        {"source_system": "ERP", "landing_zone": "bronze/erp", "files": ["one.csv"]},
        {"source_system": "CRM", "landing_zone": "bronze/crm", "files": ["two.csv"]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    schemas = {"one": text_schema("id"), "two": text_schema("id")}
    written = files.land_from_manifest(spark, str(tmp_path / "m.json"), str(tmp_path), str(tmp_path / "out"), schemas)
    assert [spark.read.parquet(p).count() for p in written] == [1, 2]


def test_json_array_of_notices(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([
        {"notice_id": "N1", "start_time_utc": "2026-06-23T20:05:00Z", "end_time_utc": "2026-06-23T20:40:00Z", "curtailed_mwh": 14.117},
        {"notice_id": "N2"}], indent=2))
    rows = files.scan_json_array(spark, str(tmp_path / "n.json"), NOTICE_SCHEMA).orderBy("notice_id").collect()
    assert rows[0].start_time_utc == dt.datetime(2026, 6, 23, 20, 5) and rows[1].curtailed_mwh is None


@pytest.mark.parametrize("shape", ["object", "list", "wrapped"])
def test_case_packages_in_three_shapes(spark, tmp_path, shape):
    case = {"breach_event_id": "B1", "asset_id": "W", "evidence_context": [{"context_rank": 1, "document_type": "PPA"}]}
    body = {"object": case, "list": [case, case | {"breach_event_id": "B2"}], "wrapped": {"cases": [case]}}[shape]
    (tmp_path / "c.json").write_text(json.dumps(body, indent=2))
    rows = files.scan_case_packages(spark, str(tmp_path / "c.json")).collect()
    assert len(rows) == (2 if shape == "list" else 1)
    assert rows[0].breach_event_id == "B1" and rows[0].evidence_context[0].document_type == "PPA"


def test_documents_with_bad_bytes_join_their_manifest(spark, tmp_path):
    import hashlib

    content = "Title\nPrice é".encode() + b"\xff end"
    (tmp_path / "doc.txt").write_bytes(content)
    manifest = spark.createDataFrame([("D1", "PPA", "P1", "W", "some/where/doc.txt")],
                                     "document_id string, document_type string, contract_id string, asset_id string, text_path string")
    row = files.scan_documents(spark, str(tmp_path / "*.txt"), manifest).first()
    assert row.document_id == "D1" and row.source_mime_type == "text/plain"
    assert row.document_version_hash == hashlib.sha256(content).hexdigest()
    assert row.raw_text_content.startswith("Title\nPrice é") and row.raw_text_content.endswith(" end")


def test_runtime_events(spark, tmp_path):
    line = {"event_id": "e", "event_type": "llm_usage", "component_name": "rag", "metrics": {"latency_ms": 12}, "attributes": {"error": None}}
    (tmp_path / "e.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line) + "\n")
    rows = files.scan_events(spark, str(tmp_path / "e.jsonl")).collect()
    assert len(rows) == 2 and rows[0].metrics == {"latency_ms": "12"}


def test_broker_options():
    plain = kafka.kafka_options("host:9092", "topic")
    assert plain == {"kafka.bootstrap.servers": "host:9092", "subscribe": "topic", "startingOffsets": "earliest"}
    secured = kafka.kafka_options("h", "t", username="u", password="p", maxOffsetsPerTrigger="10")
    assert secured["kafka.security.protocol"] == "SASL_SSL" and secured["maxOffsetsPerTrigger"] == "10"
    assert 'ScramLoginModule required username="u" password="p";' in secured["kafka.sasl.jaas.config"]
    assert "PlainLoginModule" in kafka.kafka_options("h", "t", username="u", password="p", mechanism="PLAIN")["kafka.sasl.jaas.config"]


@pytest.mark.parametrize("name,good", [("a.b", True), ("c.a_1.b", True), ("a", False), ("a.b.c.d", False), ("a.b; drop", False), ("1a.b", False), ("a.b\n", False)])
def test_table_names(name, good):
    if good:
        assert sinks.check_table_name(name) == name
    else:
        with pytest.raises(ValueError):
            sinks.check_table_name(name)


def test_upsert_is_idempotent_and_newest_update_counts(spark):
    target = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, at int, v string")
    updates = spark.createDataFrame([(2, 1, "x"), (2, 2, "y"), (3, 1, "z")], "id int, at int, v string")
    once = merge.upsert(target, updates, ["id"], ["at"])
    assert sorted((r.id, r.v) for r in once.collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert merge.upsert(once, updates, ["id"], ["at"]).exceptAll(once).count() == 0


def test_insert_ignore(spark):
    target = spark.createDataFrame([(1, 0, "a")], "id int, at int, v string")
    rows = spark.createDataFrame([(1, 1, "x"), (2, 2, "late"), (2, 1, "first")], "id int, at int, v string")
    assert sorted((r.id, r.v) for r in merge.insert_ignore(target, rows, ["id"], ["at"]).collect()) == [(1, "a"), (2, "first")]


def test_merge_into_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 0, "a", "d1"), (2, 0, "b", "d2")], "id int, at int, v string, day string")
    merge.merge_into(spark, path, rows, ["id"], ["at"], "day")
    untouched = sorted(p.name for p in (tmp_path / "t" / "day=d1").glob("*.parquet"))
    later = spark.createDataFrame([(2, 1, "c", "d2"), (3, 1, "d", "d3")], "id int, at int, v string, day string")
    for _ in range(2):
        merge.merge_into(spark, path, later, ["id"], ["at"], "day")
    assert sorted((r.id, r.v, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a", "d1"), (2, "c", "d2"), (3, "d", "d3")]
    assert sorted(p.name for p in (tmp_path / "t" / "day=d1").glob("*.parquet")) == untouched


def _parent(pid, contract, version, file, minute):
    return (pid, contract, None, None, None, version, file, dt.datetime(2026, 1, 1, 0, minute))


PARENT = ("parent_id string, contract_id string, contract_name string, offtaker_name string, asset_id string, "
          "document_version_hash string, source_file_name string, ingested_at_timestamp timestamp")
CHUNK = "chunk_id long, parent_id string, contract_id string, document_version_hash string, chunk_index int, text_snippet string"


def test_reingestion_keeps_the_parent_id_and_replaces_its_chunks(spark):
    parents = spark.createDataFrame([_parent("p1", "C", "v1", "old.txt", 0)], PARENT)
    chunks = spark.createDataFrame([(1, "p1", "C", "v1", 0, "old"), (2, "p1", "C", "v1", 1, "old")], CHUNK)
    batch = spark.createDataFrame([_parent("p9", "C", "v1", "new.txt", 5), _parent("p8", "C", "v2", "new2.txt", 6)], PARENT)
    new = spark.createDataFrame([(3, "p9", "C", "v1", 0, "new"), (4, "p8", "C", "v2", 0, "new2")], CHUNK)
    merged, kept = merge.ingest_documents(parents, chunks, batch, new)
    assert sorted((r.parent_id, r.source_file_name) for r in merged.collect()) == [("p1", "new.txt"), ("p8", "new2.txt")]
    assert sorted((r.parent_id, r.text_snippet) for r in kept.collect()) == [("p1", "new"), ("p8", "new2")]
    again, same = merge.ingest_documents(merged, kept, batch, new)
    assert again.exceptAll(merged).count() == 0 and same.exceptAll(kept).count() == 0


def test_case_lookup_round_trip(spark):
    cases = spark.createDataFrame([("B1", [(1, "D", "PPA", "R", 95, 0, 'say "x"')]), ("B2", None)],
                                  T.StructType([T.StructField("breach_event_id", T.StringType()), T.StructField("evidence_context", EVIDENCE_TYPE)]))
    back = sinks.restore_evidence(sinks.get_cases(cases, ["B1", "B2", "B3"]), EVIDENCE_TYPE).orderBy("breach_event_id").collect()
    assert back[0].evidence_context[0].chunk_text == 'say "x"' and back[1].evidence_context == []
    assert sinks.get_case(cases, "B1").count() == 1 and sinks.get_case(cases, "B3").count() == 0


def test_breach_export_and_result_append(spark, tmp_path):
    rows = spark.createDataFrame([("B1", 1.5)], "breach_event_id string, usd double")
    sinks.export_breach_json(rows, str(tmp_path / "j"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).first() == rows.first()
    for _ in range(2):
        sinks.append_results(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_work_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert work_root(spark) == configured.rstrip("/")
    assert work_path(spark, "x").startswith(work_root(spark)) and work_path(spark, "x") != work_path(spark, "x")
    stored = materialize(spark.range(10).withColumn("m", F.create_map(F.lit("a"), F.lit(1))))
    assert stored.count() == 10 and "range" not in stored._jdf.queryExecution().toString().lower()


def test_zones():
    assert zone_path("s3://x/", "gold", "facts") == "s3://x/gold/facts"
    with pytest.raises(ValueError):
        zone_path("s3://x", "platinum", "facts")


def test_null_keys_match_nothing(spark):
    from gridledger.sources import merge

    target = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 3), (None, 4), (None, 5)], "k string, v int")
    got = sorted((r.k or "", r.v) for r in merge.upsert(target, new, ["k"], ["v"]).collect())
    assert got == [("", 2), ("", 4), ("", 5), ("a", 3)]
    got = sorted((r.k or "", r.v) for r in merge.insert_ignore(target, new, ["k"], ["v"]).collect())
    assert got == [("", 2), ("", 4), ("", 5), ("a", 1)]


def test_merges_leave_few_files_and_no_stages(spark, tmp_path):
    path, before = str(tmp_path / "table"), set(os.listdir(work_root(spark)))
    for n in range(50):
        rows = spark.range(n % 5, 300, 7).select(
            "id", F.lit(n).alias("at"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).alias("day"))
        merge.merge_into(spark, path, rows, ["id"], ["at"], "day", rows_per_file=100)
    assert set(os.listdir(work_root(spark))) == before
    table = spark.read.parquet(path)
    ids = {i for n in range(5) for i in range(n, 300, 7)}
    assert table.count() == len(ids) and table.agg(F.min("at")).first()[0] >= 45
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "table").glob("day=*"))
    merge.merge_into(spark, path, table.withColumn("at", F.lit(99)), ["id"], ["at"], "day", rows_per_file=20)
    per_day = {folder.name: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "table").glob("day=*")}
    assert spark.read.parquet(path).count() == len(ids) and all(2 <= n <= 5 for n in per_day.values())


def test_single_files_are_written_by_many_tasks_and_folder(spark, tmp_path):
    """A table read in one part is not written by one task, and no folder by two."""
    from gridledger.plans.files import _file_each

    rows = spark.range(600).coalesce(1).selectExpr("id", "concat('text ', id % 500) AS text")
    _file_each(rows, "id", str(tmp_path / "out"))
    written = [(f.parent.name, f.name[:10]) for f in (tmp_path / "out").glob("folder=*/part-*")]
    assert len(written) == 600 and len({part for _, part in written}) > 20
    assert len(set(written)) == len({folder for folder, _ in written})
    found = files.scan_documents(spark, str(tmp_path / "out"))
    assert found.count() == 600 and found.select("document_version_hash").distinct().count() == 500


def test_files_of_a_mounted_folder_are_those_of_sparks_reader(spark, tmp_path):
    """Any depth and name; what Spark hides and empty files are left out. No list of files reaches the driver."""
    root = tmp_path / "in"
    names = ["a.txt", "x/b c.md", "x/y=1/100%é.pdf", "x/.hidden.txt", "x/_skipped.txt", "_gone/c.txt", ".h/d.txt", "_k=1/e.html",
             "x/empty.txt", "x/f._COPYING_", "x/z/_metadata", "x/#g?.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else name.encode() + b"\xff\r\n")
    (root / "none").mkdir()
    found = files.scan_documents(spark, str(root))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    assert "Scan binaryFile" not in found._jdf.queryExecution().toString()
    assert sorted(found.select("path", "document_version_hash").collect()) == sorted(
        plain.select("path", F.sha2("content", 256).alias("document_version_hash")).collect())
    assert files.scan_documents(spark, f"file://{root}").count() == found.count() == 5
    assert files.scan_documents(spark, str(root / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_documents(spark, str(root / "missing"))


def test_single_files_cost_no_process_each(spark, tmp_path):
    """Null texts and repeated keys are files too; no checksum file, no folder of an attempt stays."""
    from gridledger.plans.files import _file_each

    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"text é {i}\n") for i in range(200)] + [(None, "no key")], "id int, text string")
    _file_each(rows, "id", str(tmp_path / "out"))
    written = list((tmp_path / "out").rglob("*"))
    assert not [f for f in written if f.name.endswith(".crc") or "_temporary" in str(f)]
    texts = [f.read_bytes().decode() for f in written if f.is_file() and f.suffix == ".txt"]
    assert sorted(texts) == sorted((r.text or "") + "\n" for r in rows.collect())
    with pytest.raises(Exception):
        _file_each(rows, "id", str(tmp_path / "out"))


def test_a_folder_of_another_attempt_stays_as_it_is(tmp_path, monkeypatch):
    import pyarrow as pa

    class Attempt:
        def __init__(self, number):
            self.number = number

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.number

    batch = pa.RecordBatch.from_arrays([pa.array([8, 9, 8]), pa.array([b"a", b"b", None])], names=["folder", "text"])
    for number, batches in ((1, [batch.slice(0, 1)]), (2, [batch]), (3, [batch])):
        monkeypatch.setattr(sinks.TaskContext, "get", classmethod(lambda cls: Attempt(number)))
        run = sinks._single_files(str(tmp_path), "folder")(iter(batches) if number > 1 else _breaks(batches))
        if number == 1:
            with pytest.raises(RuntimeError):
                list(run)
        else:
            assert [b.column(0).to_pylist() for b in run] == [[3]]
        assert sorted(f.name for f in tmp_path.glob("folder=*")) == ([] if number == 1 else ["folder=8", "folder=9"])
    assert sorted(f.read_bytes() for f in tmp_path.glob("folder=*/part-*")) == [b"\n", b"a\n", b"b\n"]


def _breaks(batches):
    yield from batches
    raise RuntimeError("lost")
