"""Chunks, tables, keywords, pipeline, configuration."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from papyra import config
from papyra.operators import chunking, keywords, language, tables
from papyra.plans import pipeline


def test_split_text():
    text = "\n\n".join("Sentence number %d is here. And more." % i for i in range(60))
    parts = chunking.split_text(text, 200, 50)
    assert all(0 < len(p) <= 200 for p in parts) and all(p in text for p in parts) and chunking.split_text("") == []
    assert max(map(len, chunking.split_text("x" * 950, 100, 0))) == 100
    with pytest.raises(ValueError):
        chunking.split_text("a", 10, 10)


def test_offsets_and_pages(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((100, 90, 50))], "k int, chunk_index int, content string")
    out = chunking.with_offsets(df, "k", 20).orderBy("chunk_index").collect()
    assert [(r.byte_start, r.byte_end, r.total_chunks) for r in out] == [(0, 100, 3), (80, 170, 3), (150, 200, 3)]
    b = F.array(*[F.struct(F.lit(s).alias("byte_start"), F.lit(e).alias("byte_end"), F.lit(p).alias("page_number")) for s, e, p in ((0, 120, 1), (120, 240, 2))])
    got = [tuple(r.p) for r in chunking.with_offsets(df, "k", 20).orderBy("chunk_index").select(chunking.page_range(F.col("byte_start"), F.col("byte_end"), b).alias("p")).collect()]
    assert got == [(1, 1), (1, 2), (2, 2)]
    assert spark.range(1).select(chunking.boundaries_valid(b).alias("v")).first().v


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["1"]],), ([],), (None,), ([["h"], [None]],)], "cells array<array<string>>")
    assert [r.m for r in df.select(tables.markdown(F.col("cells")).alias("m")).collect()] == ["| a | b\\|c |\n| ------ | ------ |\n| 1 |  |", "", "", "| h |\n| ------ |\n|  |"]
    words = spark.createDataFrame([(1, "a", 10.0, 0.0, 10.0), (1, "b", 100.0, 1.0, 10.0), (1, "c", 11.0, 30.0, 10.0)], "page int, text string, left double, top double, height double")
    assert [r.cells for r in tables.reconstruct(words, "page").orderBy("row_no").collect()] == [["a", "b"], ["c", ""]]
    assert spark.createDataFrame([([["", "x"], ["", ""], ["", "y"]],)], "c array<array<string>>").select(tables.drop_empty(F.col("c")).alias("d")).first().d == [["x"], ["y"]]
    tsv = "level\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tword\n4\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tno\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t10\tlow"
    assert [w.text for w in spark.createDataFrame([(tsv,)], "t string").select(tables.tsv_words(F.col("t"), 50.0).alias("w")).first().w] == ["word"]


def test_rake_and_yake(spark):
    df = spark.createDataFrame([(1, "deep learning is the study of deep networks", ["is", "the", "of"]), (2, "", []), (3, None, None)], "k int, t string, s array<string>")
    got = {r.keyword: r.score for r in keywords.rake(df, "k", "t", "s").collect()}
    assert got["deep learning"] == 1.0 == got["deep networks"] and got["study"] == 0.0
    assert {r.k for r in keywords.yake(df, "k", "t", "s").collect()} == {1}
    assert all(0 <= v <= 1 for _, v in keywords.yake_one("Spark runs. Spark joins tables. Tables spill.", {"the"}))


def test_language(spark):
    words = spark.createDataFrame([("eng", "the"), ("eng", "of"), ("deu", "der")], "lang string, word string")
    df = spark.createDataFrame([(1, "The top of the hill"), (2, "der"), (3, None), (4, "zzz")], "k int, t string")
    assert {r.k: r.lang for r in language.detect(df, "k", "t", words).collect()} == {1: "eng", 2: "deu"}
    codes = spark.createDataFrame([(" EN-gb",), ("deu",), ("x",), (None,)], "c string").select(language.iso3(F.col("c")).alias("l")).collect()
    assert [r.l for r in codes] == ["eng", "deu", None, None]


def test_pipeline_order_and_validators(spark):
    seen = []

    def tag(name):
        def f(d):
            seen.append(name)
            return d

        return f

    items = [pipeline.Processor("late", "late", 99, tag("late")), pipeline.Processor("b", "early", 1, tag("b")), pipeline.Processor("a", "early", 2, tag("a"))]
    df = spark.createDataFrame([Row(x=1), Row(x=-1)])
    checks = [pipeline.Validator("v1", 1, lambda d: F.when(F.col("x") < 0, F.lit("low"))), pipeline.Validator("v2", 9, lambda d: F.when(F.col("x") < 0, F.lit("first")))]
    assert [r.error for r in pipeline.run(df, items, checks, deny={"late"}).orderBy(F.desc("x")).collect()] == [None, "first"]
    assert seen == ["a", "b"]
    assert [p.name for p in pipeline.selected(items, {"b"}, {"b"})] == ["b"]
    with pytest.raises(ValueError):
        pipeline.Registry().register(pipeline.Validator("a b", 1, lambda d: None))


def test_config(tmp_path):
    (tmp_path / "papyra.toml").write_text("force_ocr = true\n[chunking]\nmax_chars = 10\nmax_overlap = 2\n")
    (tmp_path / "x").mkdir()
    c = config.discover(tmp_path / "x")
    assert c.force_ocr and config.get(c, "chunking.max_chars") == 10 and config.get(c, "ocr.psm") is None
    assert config.merge(config.Extraction(use_cache=False), c).chunking.max_overlap == 2
    for bad in ({"chunking": {"max_chars": 1, "max_overlap": 1}}, {"ocr": {"psm": 99}}, {"token_reduction": {"mode": "x"}}):
        with pytest.raises(ValueError):
            config.of_dict(bad)


def test_every_query_is_named_once():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_pipeline_keywords_and_validators(spark):
    from papyra.config import Chunking, Extraction, Keywords, LanguageDetection, Postprocessor
    from papyra.plans import pipeline as P

    text = "deep learning is the study of deep networks, and it is on the list of the lectures in spring"
    df = spark.createDataFrame([(1, text), (2, " "), (3, None), (4, "zebra zebra")], "id int, content string")
    config = Extraction(keywords=Keywords("rake", 3), chunking=Chunking(40, 5), language_detection=LanguageDetection(min_confidence=0.1))
    rows = {r.id: r for r in P.run_configured(df, config, checks=P.default_validators()).collect()}
    assert [k.keyword for k in rows[1].keywords] == ["deep learning", "deep networks", "lectures"]
    assert rows[4].keywords is None and rows[2].keywords is None and [rows[i].error for i in (1, 2, 3, 4)] == [None, "empty text", "empty text", None]
    assert rows[1].chunk_count == len(rows[1].chunks) > 1 and rows[1].detected_languages == ["eng"] and rows[3].detected_languages is None and rows[1].quality_score > 0
    bare = P.run_configured(df, Extraction(keywords=Keywords(), postprocessor=Postprocessor(enabled=False)))
    assert "keywords" not in bare.columns and "quality_score" not in bare.columns
    only = P.run_configured(df, Extraction(keywords=Keywords(), postprocessor=Postprocessor(disabled_processors=("quality",))))
    assert "keywords" in only.columns and "quality_score" not in only.columns
    assert df.select(P.estimated_ms(df, P.default_processors()).alias("ms")).first().ms > 10
