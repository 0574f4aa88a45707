"""The pipeline end to end on planted cases, and its filtering stages on odd columns."""

import random
import zlib

import pytest

import corpus_pipeline
from paperloom.llm import quality_classifier, secrets

KEYS = "password = hunter2222"


def prose(rng, n):
    return " ".join(f"{'abcdefghij'[rng.randrange(10)]}w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    rows = [(k, prose(rng, 60) if k % 3 else "BUY!! NOW!! " * 20, "en", "s", 0) for k in range(240)]
    base, item = prose(rng, 100), prose(rng, 12)
    rows += [(1000 + k, base + " end" * (k % 2), "en", "s", 0) for k in range(4)]
    rows += [(1100, prose(rng, 30) + " " + item.upper() + " " + prose(rng, 30), "en", "s", 0)]
    rows += [(1200, prose(rng, 30) + f" {KEYS} " + prose(rng, 30), None, None, None), (1300, None, None, None, None), (1301, "", "en", "s", 0), (1, rows[1][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_result(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not [k for k in seen["quality"] if k < 240 and k % 3 == 0]
    assert {1000} == {k for k in seen["near_duplicates"] if 1000 <= k < 1004} and docs.where("doc_id = 1").count() == 1
    assert 1100 in seen["near_duplicates"] and 1100 not in seen["decontaminate"]
    assert "hunter2222" in seen["decontaminate"][1200] and "hunter2222" not in seen["secrets"][1200]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(seen["secrets"])
    assert all(r["length"] <= 4096 for r in rows)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_of_filtering_stages(spark, folder):
    text = f"{KEYS} and some words"
    docs = spark.createDataFrame([(1, text, "other"), (1, text, None), (2, None, KEYS), (3, "x" * 300_000, "")], "doc_id long, text string, last string").toDF("doc_id", "text", "text")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert sorted(map(repr, (r[2] for r in got))) == sorted(map(repr, ["other", None, KEYS, ""]))
    assert sum("[SECRET]" in (r[1] or "") for r in got) == 2
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").toDF("doc_id", "text", "text")
    kept = quality_classifier.keep_good(known, labels)
    assert kept.columns == known.columns and not [r[0] for r in kept.collect() if r[0] < 240 and r[0] % 3 == 0 and zlib.crc32(str(r[0]).encode()) % 5]
