"""Readers on made-up files, reduction scores worked out by hand, encodings, images, plans, stop words, languages."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from papyra.functions import encoding, planning, reduce, stopwords
from papyra.operators import chunking, keywords, language, tables
from papyra.sources import extractors, images, markup
from papyra.sources.samples import png, samples


@pytest.mark.parametrize("s", samples(), ids=lambda s: s.name)
def test_sample(s):
    content, _, _, found, error = extractors.read_one(s.data, s.mime)
    assert (content, found, error) == (s.text, [[list(r) for r in t] for t in s.tables], s.error)


def test_sentence_score_by_hand():
    s = "NASA has 3 probes"
    # edge 0.3, length 0.2, one number of four words 0.075, one acronym 0.0625, three different words of four 0.1125
    assert reduce.sentence_score(s, 0, 5) - reduce.ENTROPY * reduce.entropy(s) == pytest.approx(0.75)
    assert reduce.sentence_score(s, 2, 5) == pytest.approx(reduce.sentence_score(s, 0, 5) - 0.3)
    assert reduce.select_sentences("One. Two. Three is a longer one with 3 words. Four. Five.") == "Three is a longer one with 3 words. Five"


def test_word_scores_by_hand():
    scores = reduce.word_scores("The analysis of data".split())
    f = (-1.3862943611 + 1) * 0.1
    assert scores == pytest.approx([0.36 + 0.1 + 0.02 + f, 0.7 + 0.02 + f, 0.34 + 0.02 + f, 0.6 + 0.1 + f])
    assert reduce.semantic("The analysis of data", 0.5) == "analysis data" == reduce.compress("The analysis of data", 0.5)
    assert reduce.compress("car runs") == "vehicle runs" and reduce.semantic("") == "" == reduce.compress("")


def test_reduction_parts():
    assert reduce.collapse("a?!b.. c!!", True) == "a?!b.. c!" and reduce.parts("(hello)!") == ("(", "hello", ")!") and reduce.parts("--") == ("--", "", "")
    assert reduce.older_light("Wait , what ?? <!-- a\nb -->Yes..") == "Wait, what? Yes."
    assert reduce.tokens("ab 学习法") == ["ab", "学习", "法"] and reduce._important("学习") and not reduce._important("plain")
    assert reduce.moderate("the end of `the code` and ```\nthe fence\n``` now", {"the", "of", "and"}) == "end `the code` ```\nthe fence\n``` now"
    assert reduce.reduce_text("x", "unknown") == "x" and reduce.reduce_text("The  cat!!", "LIGHT") == "The cat!"
    import re

    assert reduce.moderate("keep the-word the", {"the", "theword"}, patterns=(re.compile("-"),)) == "keep the-word"


LEGACY = [("Grüße aus Köln, schöne Straße.", "cp1252"), ("Это письмо лежит в городском архиве.", "cp1251"), ("Это письмо лежит в городском архиве.", "koi8-r"), ("שלום עולם זה מכתב", "cp1255"), ("هذه رسالة من الأرشيف", "cp1256"), ("Zażółć gęślą jaźń w archiwum miasta łódź", "cp1250"),
          ("これは手紙です。保管してください。", "shift_jis"), ("これは手紙です。保管してください。", "euc_jp"), ("这是一封信，保存在档案馆里，我们都知道", "gb18030"), ("Αυτό το γράμμα είναι στο αρχείο", "cp1253"), ("zwölf", "utf-16"), ("zwölf", "utf-8-sig")]


@pytest.mark.parametrize("text,name", LEGACY, ids=[n for _, n in LEGACY])
def test_decode(text, name):
    assert encoding.safe_decode(text.encode(name)) == text
    assert encoding.safe_decode(b"") == "" and encoding.safe_decode(None) is None and encoding.safe_decode(b"\xff\xfe\xfd", "no-such") is not None
    assert encoding.safe_decode("é".encode("latin-1"), "latin-1") == "é" and encoding.is_boundary("é".encode(), 2) and not encoding.is_boundary("é".encode(), 1)


def test_images():
    exif = b"II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0\x05\0\0\0\x1a\0\0\0\0\0\0\0Acme\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 40, 60) + b"\x03" + b"\0" * 12
    assert images.image_metadata(jpeg) == {"width": 60, "height": 40, "format": "JPEG", "frames": 1, "exif": {"Make": "Acme"}}
    assert images.image_metadata(b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 8)["width"] == 3
    frame = lambda at, nxt: struct.pack("<HHHIIHHIII", 2, 256, 4, 1, 70, 257, 4, 1, 50, nxt)
    tiff = b"II*\0\x08\0\0\0" + frame(8, 38) + frame(38, 0)
    assert images.image_metadata(tiff) == {"width": 70, "height": 50, "format": "TIFF", "frames": 2, "exif": {}}
    for bad in (b"", b"xx", b"\x89PNG\r\n\x1a\n"):
        assert extractors.read_one(bad, "image/png")[4] is not None
    page = '<p><img src="data:image/png;base64,QUJD" alt="abc"><svg width="1"><g/></svg><img src="x.png"><img src="data:image/svg+xml,%3Csvg/%3E"><img src="data:image/png;base64,***"></p>'
    assert images.inline_images(page) == [("png", "abc", b"ABC"), ("svg", "", b'<svg width="1"><g/></svg>'), ("svg", "", b"<svg/>")]


def test_image_hashes(spark):
    rows = [(1, b"a" * 10, "png"), (2, b"a" * 10, "png"), (3, b"b" + b"a" * 5000, "png"), (4, b"b" + b"a" * 5000, "jpg"), (5, b"c" + b"a" * 5000, "png"), (6, None, None)]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k int, d binary, f string").select("k", images.image_hash(F.col("d"), F.col("f")).alias("h")).collect()}
    assert got[1] == got[2] and len({got[3], got[4], got[5], got[1]}) == 4 and got[6] is None
    import zlib

    assert got[1] == zlib.crc32(b"a" * 10)
    key = lambda s: spark.createDataFrame(rows[:1], "k int, d binary, f string").select(images.ocr_cache_key(F.col("d"), "tesseract", s).alias("k")).first().k
    assert key({"a": 1, "b": 2}) == key({"b": 2, "a": 1}) != key({"a": 2, "b": 2})


def test_older_json_and_rendering():
    node = {"title": "T", "a": {"name": "x", "n": 1}, "l": ["p", {"q": None, "r": True}], "e": " "}
    assert [x for x, _ in markup.json_lines(node)] == ["title: T", "a.name: x", "a.n: 1", "l[0]: p", "l[1].r: True"]
    assert [x for x, t in markup.json_lines(node) if t] == ["title: T", "a.name: x"]
    assert "a: [nested object with 2 properties]" in [x for x, _ in markup.json_lines(node, nested=False)] and "a.n (int): 1" in [x for x, _ in markup.json_lines(node, typed=True)]
    assert markup.rendered("Text \n", ["| a |", ""], {"k": 1}) == 'Text\n\n## Tables\n\n### Table 1\n\n| a |\n\n### Table 2\n\n_No table data available._\n\n## Metadata\n\n```json\n{\n  "k": 1\n}\n```'
    assert markup.hocr_markdown("") == "" and markup.rendered(None, None) == ""


def test_plans(spark):
    assert [planning.workers(n, 8) for n in (0, 1, 3, 4, 100)] == [1, 1, 3, 8, 8] and planning.workers(100, 8, False) == 16 and planning.workers(10, 8, False) == 10
    assert planning.partitions(1 << 30, 4) == 8 and planning.partitions(1, 4) == 4
    df = spark.createDataFrame([(1000, 400), (12000, 9000), (100, 0), (None, 1)], "w int, h int")
    got = [r.a for r in df.select(planning.dpi_advice(F.col("w"), F.col("h"), 300, 150, 4096).alias("a")).collect()]
    assert got[0].recommended_dpi == 195.0 and got[0].is_landscape and got[1].performance_impact == "high" and got[1].is_large and got[1].quality_impact == "high" and got[2].recommended_dpi == 150.0 and got[3] is None
    assert df.select(planning.ocr_seconds(F.col("w"), F.col("h"), "easyocr").alias("s")).first().s == pytest.approx(1.6)


def test_stop_words(spark):
    words = spark.createDataFrame([("eng", "The"), ("eng", "hello"), ("deu", "der")], "lang string, word string")
    got = {r.lang: r.stop for r in stopwords.lists(words, {"eng": ["Foo"], "fra": ["le"]}).collect()}
    assert got == {"eng": ["foo", "the"], "deu": ["der"], "fra": ["le"]}
    codes = spark.createDataFrame([("en-US",), ("PT_br",), ("deu",), ("x",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(stopwords.normalized(F.col("c")), stopwords.supported(F.col("c"))).collect()] == [("en", True), ("pt", True), ("de", True), ("x", False), (None, None)]


def test_keywords_by_settings(spark):
    from papyra.config import Keywords

    found = ["deep learning", "study", "deep networks", "a b c d"]
    assert keywords.rake_one(found, ngrams=(2, 2)) == [("deep learning", 1.0), ("deep networks", 1.0)] and keywords.rake_one([], 3) == []
    assert [p for p, _ in keywords.rake_one(found, min_score=0.5)] == ["deep learning", "deep networks"] and keywords.rake_one(found, min_length=50) == []
    df = spark.createDataFrame([(1, "der Hund und die Katze", ["hund", "katze", "der", "und", "die"])], "k int, t string, s array<string>")
    assert {r.keyword for r in keywords.rake(df, "k", "t", "s", fallback=["der", "und", "die"]).collect()} == {"hund", "katze"}
    assert keywords.extract(df, "k", "t", "s", Keywords("yake", ngram_range=(2, 3))).count() == 0


def test_markdown_chunks():
    text = "# A\n\n" + "word " * 30 + "\n\n# B\n\n```\n" + "code line\n" * 8 + "```\n\n" + "tail " * 30
    parts = chunking.split_markdown(text, 180, 0)
    assert all(len(p) <= 180 for p in parts) and any("# B" in p for p in parts) and any("```\ncode line" in p and p.count("```") == 2 for p in parts)
    assert chunking.split_markdown("") == [] and "".join(parts).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_language_profiles(spark):
    d = language.Detector({"aaa": language.trigrams("alpha beta gamma"), "bbb": language.trigrams("uno dos tres")})
    assert d.one("beta gamma")[0] == "aaa" and d.one("1234") is None and d.languages(" ") is None
    assert [x for x, _ in d.slices("alpha beta gamma " * 20 + "uno dos tres " * 40, 0.1)] == ["bbb", "aaa"]
    df = spark.createDataFrame([(1, "eng", "the cat and the dog"), (2, "deu", "der Hund und die Katze"), (3, None, None)], "k int, l string, t string")
    known = language.profiles(df, "l", "t")
    assert {r.k: r.lang for r in language.detect_trigrams(df, "k", "t", known).collect()} == {1: "eng", 2: "deu"}


def test_rendered_column(spark):
    df = spark.createDataFrame([(" text ", ["| a |", None], "{}"), (None, [], None), (None, None, "")], "c string, t array<string>, m string")
    got = [r.r for r in df.select(tables.rendered(F.col("c"), F.col("t"), F.col("m")).alias("r")).collect()]
    assert got == ["text\n\n## Tables\n\n### Table 1\n\n| a |\n\n### Table 2\n\n_No table data available._\n\n## Metadata\n\n```json\n{}\n```", "", ""]


def test_sample_table_is_complete():
    assert len({s.name for s in samples()}) == len(samples()) and json.dumps([s.text for s in samples()]) and png(1, 1)[:4] == b"\x89PNG"


def test_files_with_the_pipeline_and_plugins(spark, tmp_path):
    import papyra
    from papyra.plans import pipeline as P

    for n, t in (("a.txt", b"some words are here for the test of it all now"), ("b.md", b"# two"), ("c.png", png(3, 4)), ("d.pdf", b"%PDF"), ("e.zzz", b"zzz")):
        (tmp_path / n).write_bytes(t)
    found = papyra.read_files(spark, str(tmp_path))
    P.ocr_backends.register(P.OcrBackend("fake", 1, ("eng",), lambda data, lang: f"{len(data)} bytes in {lang}"))
    P.readers.register(P.Reader("zzz", 9, ("application/pdf",), lambda data: ("read", {}, [])))
    try:
        config = papyra.Extraction(force_ocr=True, ocr=papyra.config.Ocr("tesseract"), keywords=papyra.Keywords("rake"))
        with pytest.raises(KeyError):
            papyra.process_files(found, config)
        got = {r.path.rsplit("/", 1)[1]: r for r in papyra.process_files(found, papyra.Extraction(keywords=papyra.Keywords("rake"), chunking=papyra.Chunking())).collect()}
        assert P.chosen_readers("fake")["image/png"](png(3, 4)) == (f"{len(png(3, 4))} bytes in eng", {"width": 3, "height": 4, "format": "PNG", "frames": 1, "exif": {}, "ocr_backend": "fake", "ocr_language": "eng"}, [])
        with pytest.raises(ValueError):
            P.chosen_readers("fake", "deu")
    finally:
        P.readers.clear()
        P.ocr_backends.clear()
    assert got["a.txt"].keywords and got["a.txt"].chunk_count == 1 and got["d.pdf"].content == "read" and got["c.png"].content == "" and got["e.zzz"].content == "zzz"
    asked = spark.createDataFrame([(found.first().path, 0), ("nowhere", 1)], "path string, input_index int")
    from papyra.sources import files

    assert [(r.path, r.error) for r in files.missing_files(asked, found).collect()] == [("nowhere", "FileNotFoundError")]
    kinds = spark.createDataFrame([("a.txt", None), ("b", None), ("c.bin", "application/x-nothing"), ("d.html", "")], "p string, m string")
    out = [tuple(r.t) for r in kinds.select(files.detect_or_validate(F.col("p"), F.col("m")).alias("t")).collect()]
    assert out == [("text/plain", None), (None, "no media type for b"), ("application/x-nothing", "unsupported media type application/x-nothing"), ("text/html", None)]


def test_public_surface():
    import papyra

    assert all(getattr(papyra, n) is not None for n in papyra.__all__)
    with pytest.raises(AttributeError):
        papyra.nothing
