"""Upserts replace points, exported ids count from 0, exports hold every record."""

import json

from pyspark.sql import functions as F

from paperloom.operators import ingest, prepare, store


def test_upsert_replaces(spark, tmp_path):
    c = store.Collections(spark, str(tmp_path))
    c.create("a", 2)
    load = lambda rows: c.upsert("a", spark.createDataFrame(rows, "embedding_id string, embedding array<float>, v int"))
    assert load([("x", [1.0, 2.0], 1), ("y", [1.0, 2.0], 1), ("bad", [1.0], 1)]) == {"uploaded": 2, "failed": 1, "total": 3}
    load([("x", [3.0, 4.0], 2), ("z", [0.0, 1.0], 2)])
    load([("z", [0.0, 1.0], 3), ("z", [0.0, 1.0], 3)])
    got = {r.embedding_id: (r.v, list(r.embedding)) for r in c.points("a").collect()}
    assert c.info("a")["points_count"] == 3
    assert got == {"x": (2, [3.0, 4.0]), "y": (1, [1.0, 2.0]), "z": (3, [0.0, 1.0])}


def test_exported_ids_are_ordinals(spark, tmp_path):
    rows = spark.range(0, 200, 1, 4).select(F.format_string("e%03d", F.lit(199) - F.col("id")).alias("embedding_id"))
    store.export_points_json(rows, f"{tmp_path}/points")
    got = sorted((json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/points").collect()), key=lambda x: x["id"])
    assert [x["id"] for x in got] == list(range(200))
    assert [x["payload"]["embedding_id"] for x in got] == [f"e{k:03d}" for k in range(200)]


def _records(spark):
    text = "A \"quoted\" line, with commas,\nand a second line. " * 3
    pages = spark.createDataFrame([("d1", "a.txt", 1, text), ("d2", "b.txt", 1, "Some other text of a document."), ("d3", "c.txt", 1, "")], "doc_id string, file_name string, page_number int, text string")
    return pages, ingest.ingest(pages)


def test_json_export_keeps_every_record_and_its_total(spark, tmp_path):
    _, recs = _records(spark)
    want = {r["embedding_id"]: r["embedding_input_text"] for r in recs.collect()}
    store.export_json(recs, f"{tmp_path}/full")
    got = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/full/records").collect()]
    assert len(want) == 2 and {x["embedding_id"]: x["embedding_input_text"] for x in got} == want
    assert json.loads(spark.read.text(f"{tmp_path}/full/summary").first()[0])["total_records"] == 2
    store.export_json(recs, f"{tmp_path}/bare", with_text=False)
    got = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/bare/records").collect()]
    assert len(got) == 2 and not any("embedding_input_text" in x or "normalized_text" in x for x in got)


def test_csv_export_reads_back(spark, tmp_path):
    _, recs = _records(spark)
    rows = prepare.csv_rows(recs)
    store.export_csv(rows, f"{tmp_path}/csv")
    got = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv")
    assert got.columns == rows.columns and len(got.columns) == 15
    assert sorted(map(tuple, got.select("embedding_id", "embedding_input_text").collect())) == sorted(map(tuple, rows.select("embedding_id", "embedding_input_text").collect()))


def test_batch_summary(spark):
    pages, _ = _records(spark)
    report = ingest.ingest_report(pages)
    got = ingest.batch_summary(report).first().asDict()
    each = report.collect()
    assert (got["documents"], got["successful"], got["failed"], got["pages_extracted"]) == (3, 3, 0, 3)
    assert all(got[c] == sum(r[c] for r in each) for c in ("chunks_created", "unique_chunks", "duplicates_removed")) and got["chunks_created"] == 2
    assert ingest.batch_summary(report.where("false")).first().asDict() == dict.fromkeys(got, 0)
