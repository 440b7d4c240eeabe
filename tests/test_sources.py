"""Extraction by format on small made-up files; media types; errors as rows; stream equals batch."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.sources import extractors as E
from papyra.sources import files, mime
from papyra.streaming.files import extract_stream


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "docProps/core.xml": "<c><title>T</title></c>"})
XLSX = zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>'})
PPTX = zipped({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sp></p:sld>'})
ODT = zipped({"content.xml": '<o xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="t"><office:text><text:h>H</text:h><text:p>para</text:p></office:text></o>'})
EPUB = zipped({"META-INF/container.xml": '<c><rootfile full-path="a/b.opf"/></c>', "a/b.opf": '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><item id="i" href="c.xhtml"/><itemref idref="i"/></p>', "a/c.xhtml": "<p>text <b>x</b></p>"})

CASES = [
    ("text/plain", b"a b\r\n", "a b"), ("text/markdown", b"---\ntitle: t\n---\n# H\nx", "# H\nx"), ("text/html", b"<p>a</p><script>x</script><ul><li>b</ul>", "a\n\n- b"),
    ("application/json", b'{"b": [1, true], "a": {"title": "x"}}', "a.title: x\nb[0]: 1\nb[1]: true"), ("application/x-yaml", b"a:\n  - 1\n", "a[0]: 1"), ("application/toml", b"[a]\nb = 'c'\n", "a.b: c"),
    ("application/xml", b"<a><b>x</b><c>y</d></a>", "x y"), ("message/rfc822", b"Subject: S\nFrom: a@b.c\n\nbody\n", "Subject: S\nFrom: a@b.c\n\nbody"),
    (mime.BY_EXTENSION["docx"], DOCX, "Hi\n\n| a |\n| ------ |"), (mime.BY_EXTENSION["xlsx"], XLSX, "## S\n\n| h | 5.0 |\n| ------ | ------ |"), (mime.BY_EXTENSION["pptx"], PPTX, "<!-- Slide 1 -->\nSlide"),
    (mime.BY_EXTENSION["odt"], ODT, "# H\n\npara"), ("application/epub+zip", EPUB, "text x"), ("application/rtf", rb"{\rtf1\ansi{\fonttbl x}A\'e9\par B}", "Aé\nB"),
    ("application/x-latex", rb"\begin{document}\section{S}a \emph{b} % c" + b"\n" + rb"\end{document}", "# S\na b"), ("text/x-rst", b"Title\n=====\n\ntext\n", "# Title\n\ntext"), ("text/x-org", b"#+TITLE: t\n* H\nx\n", "# H\nx"),
    ("application/x-typst", b'#set page()\n= H\n#link("u")[t]\n', "= H\n[t](u)"), ("application/x-ipynb+json", json.dumps({"metadata": {}, "cells": [{"cell_type": "code", "source": ["x"], "outputs": [{"text": "1\n"}]}]}).encode(), "```\nx\n```\n\n1"),
    ("application/x-opml+xml", b'<opml><body><outline text="a"><outline text="b"/></outline></body></opml>', "a\n  b"), ("application/x-fictionbook+xml", b"<FictionBook><body><section><title><p>T</p></title><p>x</p></section></body></FictionBook>", "## T\n\nx"),
    ("application/docbook+xml", b"<book><title>T</title><para>x</para></book>", "# T\n\nx"), ("application/x-jats+xml", b"<article><front><article-title>T</article-title></front><body><p>x</p></body></article>", "# T\n\nx"),
]


@pytest.mark.parametrize("kind,data,want", CASES, ids=[c[0].rsplit("/", 1)[-1][:20] for c in CASES])
def test_reader(kind, data, want):
    text, _, _, _, error = E.read_one(data, kind)
    assert error is None and text == want


def test_archives_and_limits(monkeypatch):
    text, _, meta, _, _ = E.read_one(zipped({"b.txt": "bee", "a/x.bin": "?"}), "application/zip")
    assert "=== b.txt ===\nbee" in text and json.loads(meta)["file_count"] == 2
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        i = tarfile.TarInfo("n.md")
        i.size = 2
        t.addfile(i, io.BytesIO(b"hi"))
    assert "hi" in E.read_one(b.getvalue(), "application/x-tar")[0]
    monkeypatch.setattr(E, "MAX_MEMBERS", 1)
    assert E.read_one(zipped({"a": "", "b": ""}), "application/zip")[4] == "ValueError"


def test_rows_with_errors_stop_nothing(spark):
    rows = [(1, "text/plain", b"x"), (2, "application/pdf", b"%PDF"), (3, "application/json", b"{"), (4, None, b"x"), (5, "text/plain", None), (6, "text/plain", b"")]
    out = {r.k: r for r in E.extract(spark.createDataFrame(rows, "k int, mime_type string, data binary"), ["k"]).collect()}
    assert len(out) == 6 and out[1].error is None and out[2].error == "Unsupported" and out[2].content.startswith("Error: ") and out[3].error and out[4].error and out[5].content is None and out[6].content == ""


def test_mime(spark):
    rows = [("a/b.TXT",), ("x.tar",), ("none",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p string").select(mime.by_extension(F.col("p")), mime.extension(F.col("p"))).collect()]
    assert got == [("text/plain", "txt"), ("application/x-tar", "tar"), (None, ""), (None, None)]
    sniffed = spark.createDataFrame([("{}",), ("{",), ("<html>",), ("[ ] x",), (None,)], "t string").select(mime.sniff_text(F.col("t")).alias("m")).collect()
    assert [r.m for r in sniffed] == ["application/json", "text/plain", "application/xml", "text/plain", None]
    assert spark.createDataFrame([(b"\x89PNG\r\n\x1a\n",)], "b binary").select(mime.sniff_bytes(F.col("b")).alias("m")).first().m == "image/png"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("a.txt", "one"), ("b.md", "# two"), ("c.json", '{"x": 3}'), ("d.pdf", "%PDF")):
        (tmp_path / "in" / n).write_text(t)
    batch = sorted((r.path, r.content, r.error) for r in files.extract_files(files.read_files(spark, str(tmp_path / "in"))).collect())
    got = []
    extract_stream(spark, str(tmp_path / "in"), lambda d, i: got.extend((r.path, r.content, r.error) for r in d.collect()), once=True).awaitTermination()
    assert sorted(got) == batch and len(batch) == 4
