"""Pages, chunks, records, collections and sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.config import ChunkConfig, NormalizeConfig, PrepareConfig, ServiceConfig
from paperloom.functions import extract as X
from paperloom.operators import chunk as C
from paperloom.operators import ingest as O
from paperloom.operators import pages as N
from paperloom.operators import prepare as E
from paperloom.operators import search as V
from paperloom.operators.store import Collections
from paperloom.sources import readers


def pages_of(spark, *texts):
    return spark.createDataFrame([("d", "d.txt", k, t) for k, t in enumerate(texts, 1)], "doc_id string, file_name string, page_number int, text string")


def test_page_filter_precedence(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, True), (4, False)], "page_number int, has_toc boolean")
    c = NormalizeConfig(skip_pages=(3,), force_process_pages=(2, 3))
    assert sorted(r[0] for r in N.filter_pages(df, c).collect()) == [1, 2, 4]


def test_nested_mark_is_not_restored():
    one = N.PageNormalizer(NormalizeConfig())
    assert one("- use `foo` now", 1, [], [])["normalized_text"] == "- use <<<PROTECTED_CODE_0>>> now"


def test_page_number_of_the_page_only():
    r = N.PageNormalizer(NormalizeConfig())("Page 3\nbody 3", 3, [], [])
    assert r["normalized_text"] == "body 3" and r["removed_page_numbers"] == ["Page 3"]


def test_toc_only_document_falls_back_to_raw_text(spark):
    rows = O.ingest(pages_of(spark, "One... two")).collect()
    assert [(r.embedding_input_text, r.page_number_start, r.page_number_end) for r in rows] == [("One... two", 1, 1)]


def test_text_before_the_first_section_goes():
    assert C.split_page("intro\n1. Title here\nbody", ChunkConfig()) == [("1. Title here\nbody", "1. T", ["1. T"], "subsection")]


@pytest.mark.parametrize(("text", "sizes"), [("x" * 1000, [1000]), ("x" * 1200, [500, 500, 200]), ("x" * 538 + "\n\n" + "y" * 660, [538, 500, 160])])
def test_sizes(spark, text, sizes):
    got = C.split(pages_of(spark, text)).orderBy("chunk_index").collect()
    assert [len(r.base_text) for r in got] == sizes


@pytest.mark.parametrize(("size", "second", "before"), [(100, "Cc dd.Ee", 6), (3, "dd.Ee", 3), (0, "Ee", 0)])
def test_overlap(spark, size, second, before):
    c = ChunkConfig(overlap_size=size)
    got = C.overlap(C.split(pages_of(spark, "Aa bb. Cc dd.", "Ee"), c), c).orderBy("chunk_index").collect()
    assert (got[1].text, got[1].overlap_with_previous, got[1].overlap_with_next) == (second, before, 0)


def test_protected_ranges_stay_whole():
    table = "\n".join("| cell %d |" % k for k in range(100))
    found = list(C.pieces("a" * 450 + "\n" + table, ChunkConfig()))
    assert all(any("| cell %d |" % k in t for t, _ in found) for k in range(100))  # no row is cut
    assert "".join(t for t, _ in found).replace("\n", "") == ("a" * 450 + table).replace("\n", "")


def test_config_that_could_not_progress_is_refused():
    with pytest.raises(ValueError):
        ChunkConfig(min_chunk_size=500)


def test_first_wins_and_statistics(spark):
    rows = spark.createDataFrame([("d", i, f"c{i}", h) for i, h in enumerate(["h1", "h2", "h1"])], "doc_id string, chunk_index int, chunk_id string, embedding_hash string")
    assert sorted(r.chunk_index for r in E.first_wins(rows).collect()) == [0, 1]
    assert sorted(r.chunk_index for r in E.first_wins(rows, PrepareConfig(dedup_scope="corpus")).collect()) == [0, 1]
    s = E.dedup_stats(rows).first()
    assert (s.total_chunks, s.unique_chunks, round(s.deduplication_rate, 2)) == (3, 2, 33.33)
    assert E.duplicate_groups(rows).first().chunk_ids == ["c0", "c2"]


def test_filters(spark):
    df = spark.createDataFrame([(k, "page") for k in range(1, 7)], "page_start int, boundary_type string")
    assert df.where(V.where_metadata({"page_start": {"gte": 2, "lt": 5}})).count() == 3
    assert df.where(V.where_metadata({"boundary_type": ["page", "section"]})).count() == 0
    assert df.where(V.where_metadata({})).count() == 6


def test_store_and_search(spark, tmp_path):
    c = ServiceConfig(store_path=str(tmp_path / "store"))
    pages = pages_of(spark, "The brown fox runs over the hill.", "Cheese is made from milk and time.")
    assert O.store(pages, c) == {"uploaded": 2, "failed": 0, "total": 2}
    hit = O.search(spark, "milk and cheese", c, limit=1).first()
    assert "milk" in hit.text
    s = Collections(spark, c.store_path)
    assert s.info("documents")["points_count"] == 2 and not s.create("documents")
    s.update("documents", hit.point_id, {"version": "9"})
    assert s.get("documents", hit.point_id).first().version == "9"
    s.delete("documents", {"version": "9"})
    assert s.info("documents")["points_count"] == 1
    assert V.match_text(s.points("documents"), "brown FOX").count() == 1
    s.drop("documents")
    assert s.info("documents") == {}


def test_normalised_document_round_trip(spark):
    meta = X.page_metadata(pages_of(spark, "First page text.", "Second page text."))
    whole = N.assemble(N.normalize_pages(meta)).withColumn("file_name", F.lit("d.txt"))
    got = C.split_marked(whole).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in got] == [(1, "First page text."), (2, "Second page text.")]


def _docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.bin").write_bytes(b"x")
    p = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "c.docx").write_bytes(_docx(p))
    (tmp_path / "d.docx").write_bytes(_docx(""))
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe")
    got = {r.file_name: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "one\ntwo\nthree"
    assert got["b.bin"].error.startswith("unsupported") and got["e.txt"].error
    assert got["c.docx"].text == "Top\n--- TABLES ---\n[Table 1]\nx | y" and got["c.docx"].sections == ["Top"]
    assert got["d.docx"].text == "" and got["d.docx"].total_sections == 1
    plain = {r.file_name: r for r in readers.read_text(spark, str(tmp_path / "*.txt")).collect()}
    assert plain["a.txt"].text == "one\ntwo\nthree" and plain["e.txt"].error == "not UTF-8"


def test_stream_loads_each_file_once(spark, tmp_path):
    from paperloom.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Some words to be found later.")
    c = ServiceConfig(store_path=str(tmp_path / "store"))
    for want in (1, 1):
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "ck"), c).awaitTermination(120)
        assert Collections(spark, c.store_path).info("documents")["points_count"] == want
