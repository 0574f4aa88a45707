"""Registered queries see whole texts, null documents, and do their work once."""

import time

import pytest

from paperloom.operators import chunk, ingest
from paperloom.plans import catalog

END = "Read https://late.example.org/end twice."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, "plain words go on here.\n" * 200 + END), (2, None), (6, END)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_no_query_cuts_a_text():
    assert "substr(text, 1," not in catalog.DECORATED and "IS NOT NULL" not in catalog.DECORATED
    assert not any("substr(text, 1," in sql for sql in catalog.ORACLES.values())


@pytest.mark.parametrize("name", ["urls_in_order", "unicode_nfkc", "listed_urls", "char_count"])
def test_whole_text(spark, folder, name):
    got = {(r["doc_id"], r["page_number"]): r["out"] for r in catalog.QUERIES[name](spark, folder).collect()}
    assert set(got) == {(d, p) for d in (1, 2, 6) for p in (1, 2)} | {(7, 3)}  # the null document too
    if name == "char_count":
        assert sum(got[1, p] - got[2, p] for p in (1, 2)) == 200 * 24 + len(END) and got[7, 3] == len(END)
    elif name == "listed_urls":
        assert got[1, 2].endswith("Read  twice.") and got[7, 3] == "Read  twice."
    else:
        assert "https://late.example.org/end" in got[1, 2] and "https://late.example.org/end" in got[7, 3]


def test_whole_chunks(spark, folder):
    texts = [r["normalized_text"] for r in catalog.QUERIES["chunk_structured"](spark, folder).collect()]
    assert sum("late.example.org/end" in t for t in texts) == 2  # the one of document 6 is cut by its pages


def _python_nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython")


def test_python_runs_once(spark, folder):
    pages = spark.createDataFrame([(1, "f.txt", 1, "a")], "doc_id long, file_name string, page_number int, text string")
    assert _python_nodes(chunk.split(pages)) == 1
    assert _python_nodes(ingest.ingest_report(pages)) == 2  # the normaliser and the splitter
    assert _python_nodes(catalog.QUERIES["dedup_corpus"](spark, folder)) == 1


def test_cutting_takes_time_in_proportion(spark):
    took = []
    for k in (1, 1, 4):
        df = spark.createDataFrame([(1, "f", 1, "plain words go on here " * 20_000 * k)], "doc_id long, file_name string, page_number int, text string")
        began = time.time()
        assert chunk.split(df).count() > 900 * k
        took.append(time.time() - began)
    assert took[2] < 10 * took[1] + 2
