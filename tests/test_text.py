"""Each text function on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import text as T
from paperloom.operators import pages as N
from paperloom.operators import prepare as E

CASES = [
    (T.remove_hyphen_line_breaks, "exam-\n  ple", "example"),
    (T.collapse_blank_lines, "a\n\n\n\nb", "a\n\nb"),
    (T.collapse_blank_lines, "a\n\nb", "a\n\nb"),
    (T.normalize_line_breaks, "a\r\nb\rc", "a\nb\nc"),
    (T.unicode_normalize, "ﬁ x", "fi x"),
    (T.remove_page_numbers, "a\n\n7\n\nb", "a\n\nb"),
    (T.remove_urls, "end.The file a.txt", " file "),
    (T.fix_broken_sentences, "rain\n\nThen", "rain Then"),
    (T.normalize_bullets, "A. Smith\n3) go\n•x", "• Smith\n• go\n• x"),
    (T.remove_duplicated_ocr_lines, "abc\ncab\nxyz", "abc\nxyz"),
    (T.remove_duplicated_ocr_lines, "abc\n\ncab", "abc\n\ncab"),
    (T.fix_ocr_confusion, "0CR 5th l1ne", "OCR Sth llne"),
    (T.remove_disclaimers, "DISCLAIMER: x.\n\nBody", "\n\nBody"),
    (T.normalize_dates, "12-31-2023", "12/31/2023"),
    (T.normalize_dates, "March  5 2024", "March 5, 2024"),
    (T.space_section_titles, "a\nOVERVIEW\nb", "a\n\nOVERVIEW\n\nb"),
    (T.clean_columns, "left      right", "left\nright"),
    (N.fix_sentences_safely, "the rain,\n\nand", "the rain, and"),
    (E.clean_for_embedding, "a\n\n\nb", "a b"),
    (E.clean_for_embedding, "a\n\nb", "a\n\nb"),
    (E.clean_for_embedding, "- use <<<PROTECTED_CODE_0>>> now", "- use  now"),
    (E.ngram_hash, "one two", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    (lambda t: F.array_join(X.extract_urls(t), " "), "See http://a.io/x, www.b.org", "http://a.io/x, www.b.org"),
    (lambda t: F.array_join(X.extract_emails(t), " "), "a@b.co|x", "a@b.co|x"),
    (lambda t: F.array_join(X.extract_headings(t), ";"), "Chapter 12\nChapter 12: Rain\nINTRO\nOVERVIEW\n1. Sco\n1. Scope", "1. Scope;Chapter 12: Rain;OVERVIEW"),
    (lambda t: X.detect_toc(t).cast("string"), "wait..", "false"),
    (lambda t: X.detect_toc(t).cast("string"), "wait...", "true"),
    (lambda t: X.detect_toc(t).cast("string"), "2.1 Heat 45", "true"),
    (lambda t: T.word_count(t).cast("string"), "  a  b ", "2"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text(spark, k):
    f, given, want = CASES[k]
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0] == want


def test_equal_content_has_equal_hashes(spark):
    df = spark.createDataFrame([("  Foo   BAR ",), ("foo bar",)], "t string").select(E.content_hash(F.col("t")).alias("h"))
    assert df.distinct().count() == 1


def test_own_page_number(spark):
    df = spark.createDataFrame([("Page 3\nbody 3", 3)], "t string, n int")
    assert df.select(N.remove_own_page_number(F.col("t"), F.col("n"))).first()[0] == "\nbody 3"
