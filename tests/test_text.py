"""Text functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import reduce
from papyra.functions import text as X

CASES = [
    (X.quality_score, None, 0.0), (X.quality_score, "", 0.0), (X.quality_score, "  \n ", 0.0), (X.quality_score, "Hello", 0.1), (X.structure_bonus, " . ", 0.2), (X.structure_bonus, "", 0.0),
    (X.word_count, None, 0), (X.word_count, " a　b\n", 2), (X.line_count, "", 0), (X.line_count, "a\r\nb\n", 2), (X.line_count, "a\n\n", 2),
    (X.collapse_punctuation, "Wow!!! Really?!?! ok,,.", "Wow! Really? ok,"), (X.collapse_punctuation, "a? b.", "a? b."), (X.reduce_light, " a  b<!-- x -->\n\n\n\nc ", "a b\n\nc"),
    (X.pdf_date, "D:20230115123045", "2023-01-15T12:30:45Z"), (X.pdf_date, "20230115", "2023-01-15T00:00:00Z"), (X.pdf_date, "soon", "soon"), (X.split_authors, "A and B; C, D", ["A", "B", "C", "D"]),
    (X.fix_mojibake, "a\x00b\ufffd\ufffdc\u0301", "abc"), (X.text_confidence, "", 0.0), (X.text_confidence, "plain words", 1.0), (X.strip_html, "<p>a <b>b</b></p>\n c", "a b c"), (X.average_word_length, "--", 5.0),
    (X.clean_dashes, "a ---- b\n| --- | --- |", "a ... b\n| --- | --- |"), (X.normalize_spaces, " a  b \n\n\n c ", "a b\n\nc"), (X.content_type, "Text/HTML; charset=x", "text/html"), (X.word_diversity, "A a b", 2 / 3),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_column(spark, f, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(f(F.col("t")).alias("r")).first().r
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_whole_metadata_counts(spark):
    rows = [('{"title": "x", "keywords": []}',), ("{",), (None,), ('"{}"',), ('[ ] a',)]
    got = [r.b for r in spark.createDataFrame(rows, "m string").select(X.metadata_bonus(F.col("m")).alias("b")).collect()]
    assert got == [0.4, 0.0, 0.0, 0.0, 0.0]


def test_ocr_fallback(spark):
    rows = [("",), (None,), ("word " * 40,), ("§§§ §§",), ("ab cd",)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(X.ocr_fallback(F.col("t"), F.lit(1)).alias("f")).collect()]
    assert got == [True, True, False, True, True]


def test_dpi(spark):
    c = spark.range(1).select(X.smart_dpi(F.lit(612.0), F.lit(792.0)).alias("a"), X.smart_dpi(F.lit(612.0), F.lit(792.0), 300, 1000).alias("b")).first()
    assert (c.a, c.b) == (300, 91)


def test_l2(spark):
    r = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(X.l2_normalize(F.col("v")).alias("n")).collect()
    assert [round(x, 6) for x in r[0].n] == [0.6, 0.8] and r[1].n == [0.0, 0.0]


def test_stop_words_keep_what_matters():
    assert reduce.moderate("the NASA 3x a `the code` of", {"the", "of", "a"}) == "NASA 3x a `the code`"
    assert reduce.moderate("# the head\nthe cat", {"the"}, True) == "# the head\ncat"
    assert reduce.reduce_text(None, "maximum") is None and reduce.reduce_text("", "maximum") == ""
    text = "One cat sat. " * 10
    assert len(reduce.reduce_text(text, "aggressive", set())) <= len(text)
    assert reduce.select_sentences("A b. C d.") == "A b. C d."
    assert 0 <= reduce.entropy("abab") <= 5
