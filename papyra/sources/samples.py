"""Small made-up files of every format, with the text and the tables that reading them gives, written by hand.

They are the inputs of the reader queries, whose SQL holds the expected values, and of the tests.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
from dataclasses import dataclass
from functools import cache

from papyra.sources.mime import BY_EXTENSION


@dataclass(frozen=True)
class Sample:
    group: str
    name: str
    mime: str
    data: bytes
    text: str
    tables: tuple = ()
    error: str | None = None


def zipped(members: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return b.getvalue()


def tarred(members: dict[str, bytes]) -> bytes:
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for name, data in members.items():
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return b.getvalue()


def arrow(columns: dict[str, list]) -> bytes:
    import pyarrow as pa

    table, out = pa.table(columns), io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def png(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0\0\0\0\0"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
_ROW = "<w:tr>" + "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>" * 2 + "</w:tr>"
_DOCX = f"<w:document {W}><w:body>{_P.format('Minutes')}{_P.format('All were there.')}<w:tbl>{_ROW.format('name', 'age')}{_ROW.format('Ann', '41')}</w:tbl>{_P.format('End')}</w:body></w:document>"
_SHEET = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>item</t></is></c><c r="B1" t="inlineStr"><is><t>price</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>pen</t></is></c><c r="B2"><v>2.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>pad</t></is></c><c r="B3"><v>4</v></c></row></sheetData></worksheet>'
_SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>{}</a:t></a:r></a:p><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sp></p:sld>'
_ODT = '<o xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="t"><office:text><text:h>Head</text:h><text:p>One line.</text:p><text:p>Another.</text:p></office:text></o>'
_NOTEBOOK = {"metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "cells": [{"cell_type": "markdown", "source": ["# Title\n", "words"]}, {"cell_type": "code", "source": ["print(1)"], "outputs": [{"text": ["1\n"]}]}]}


@cache
def samples() -> tuple[Sample, ...]:
    s = Sample
    t = lambda *rows: tuple(tuple(r) for r in rows)
    return (
        s("text", "plain", "text/plain", b"first line\nsecond  line\r\n", "first line\nsecond  line"),
        s("text", "plain_latin", "text/plain", "Grüße aus Köln".encode("cp1252"), "Grüße aus Köln"),
        s("text", "plain_cyrillic", "text/plain", "Письмо лежит в городском архиве".encode("cp1251"), "Письмо лежит в городском архиве"),
        s("text", "plain_utf16", "text/plain", "zwölf".encode("utf-16"), "zwölf"),
        s("text", "empty", "text/plain", b"", ""),
        s("text", "csv", "text/csv", b'a,b\n"x, y",2\n', 'a,b\n"x, y",2', (t(("a", "b"), ("x, y", "2")),)),
        s("text", "csv_header_only", "text/csv", b"a,b\n", "a,b"),
        s("text", "tsv", "text/tab-separated-values", b"a\tb\n1\t2\n", "a\tb\n1\t2", (t(("a", "b"), ("1", "2")),)),
        s("text", "json", "application/json", b'{"b": [1, true, null], "a": {"title": "x"}}', "a.title: x\nb[0]: 1\nb[1]: true"),
        s("text", "json_broken", "application/json", b'{"a": ', "Error: Expecting value: line 1 column 7 (char 6)", error="JSONDecodeError"),
        s("text", "yaml", "application/x-yaml", b"a:\n  - 1\n  - b: two\n", "a[0]: 1\na[1].b: two"),
        s("text", "toml", "application/toml", b"[a]\nb = 'c'\nn = 3\n", "a.b: c\na.n: 3"),
        s("text", "xml", "application/xml", b"<a><!-- no --><b>x &amp; y</b><![CDATA[<z>]]></a>", "x & y"),
        s("markup", "markdown", "text/markdown", b"---\ntitle: t\n---\n# Head\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "# Head\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", (t(("a", "b"), ("1", "2")),)),
        s("markup", "html", "text/html", b"<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>One <b>bold</b> <a href='u'>link</a></p><script>no</script><ul><li>a<li>b</ul></body></html>", "# Head\n\nOne **bold** [link](u)\n\n- a\n- b"),
        s("markup", "html_table", "text/html", b"<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table>", "x\n\n| a | b |\n| ------ | ------ |\n| 1 | 2\\|3 |", (t(("a", "b"), ("1", "2|3")),)),
        s("markup", "latex", "application/x-latex", b"\\documentclass{article}\n\\begin{document}\n\\section{Intro}\nSome \\emph{text} with $x^2$. % no\n\\begin{enumerate}\\item one \\item two\\end{enumerate}\n\\begin{tikzpicture}no\\end{tikzpicture}\n\\end{document}\n", "# Intro\n\nSome text with $x^2$.\n\n1. one\n2. two"),
        s("markup", "rst", "text/x-rst", b"Title\n=====\n\nSome text.\n", "# Title\n\nSome text."),
        s("markup", "org", "text/x-org", b"#+TITLE: t\n* Head\ntext\n\n** Sub\n", "# Head\ntext\n# Sub"),
        s("markup", "typst", "application/x-typst", b'#set page()\n= Head\n+ one\n#link("u")[there]\n', "= Head\n- one\n[there](u)"),
        s("markup", "rtf", "application/rtf", rb"{\rtf1\ansi{\fonttbl x}Caf\'e9\par Next}", "Café\nNext"),
        s("markup", "hocr", "text/x-hocr", b'<div class="ocr_page"><h1>Top</h1><p class="ocr_par"><span class="ocrx_word">Hello</span> <em class="ocrx_word">there</em></p><p class="ocr_par">Second</p></div>', "# Top\n\nHello *there*\n\nSecond"),
        s("books", "epub", "application/epub+zip", zipped({"META-INF/container.xml": '<c><rootfile full-path="a/b.opf"/></c>', "a/b.opf": '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><item id="i" href="c.xhtml"/><itemref idref="i"/></p>', "a/c.xhtml": "<p>text <b>strong</b></p>"}), "text strong"),
        s("books", "fictionbook", "application/x-fictionbook+xml", b"<FictionBook><body><section><title><p>Part</p></title><p>It began.</p><cite><p>said</p></cite></section></body><body name='notes'><p>no</p></body></FictionBook>", "## Part\n\nIt began.\n\n> said"),
        s("books", "docbook", "application/docbook+xml", b"<book><title>T</title><chapter><title>C</title><para>x</para><orderedlist><listitem><para>a</para></listitem><listitem><para>b</para></listitem></orderedlist></chapter></book>", "# T\n\n## C\n\nx\n\n1. a\n2. b"),
        s("books", "jats", "application/x-jats+xml", b"<article><front><article-title>T</article-title></front><body><p>x</p></body></article>", "# T\n\nx"),
        s("books", "bibtex", "application/x-bibtex", b"@book{k1,\n  author = {Ann Lee and Bo Ek},\n  year = {1999}\n}\n", "book: k1\nauthor: Ann Lee and Bo Ek\nyear: 1999"),
        s("books", "notebook", "application/x-ipynb+json", json.dumps(_NOTEBOOK).encode(), "# Title\nwords\n\n```python\nprint(1)\n```\n\n1"),
        s("books", "opml", "application/x-opml+xml", b'<opml><head><title>t</title></head><body><outline text="a"><outline text="b"/></outline><outline text="c"/></body></opml>', "a\n  b\nc"),
        s("office", "docx", BY_EXTENSION["docx"], zipped({"word/document.xml": _DOCX, "docProps/core.xml": "<c><title>T</title></c>"}), "Minutes\n\nAll were there.\n\n| name | age |\n| ------ | ------ |\n| Ann | 41 |\n\nEnd", (t(("name", "age"), ("Ann", "41")),)),
        s("office", "xlsx", BY_EXTENSION["xlsx"], zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="Prices"/></sheets></workbook>', "xl/worksheets/sheet1.xml": _SHEET}), "## Prices\n\n| item | price |\n| ------ | ------ |\n| pen | 2.5 |\n| pad | 4.0 |", (t(("item", "price"), ("pen", "2.5"), ("pad", "4.0")),)),
        s("office", "pptx", BY_EXTENSION["pptx"], zipped({"ppt/slides/slide1.xml": _SLIDE.format("One", "first"), "ppt/slides/slide2.xml": _SLIDE.format("Two", "second")}), "<!-- Slide 1 -->\nOne\nfirst\n\n<!-- Slide 2 -->\nTwo\nsecond"),
        s("office", "odt", BY_EXTENSION["odt"], zipped({"content.xml": _ODT}), "# Head\n\nOne line.\n\nAnother."),
        s("office", "arrow", "application/vnd.apache.arrow.file", arrow({"a": [1, None], "b": ["x", "y"]}), "| a | b | \n|------|------|\n| 1 | x | \n|  | y | \n", (t(("a", "b"), ("1", "x"), ("", "y")),)),
        s("office", "docx_broken", BY_EXTENSION["docx"], b"no zip", "Error: File is not a zip file", error="BadZipFile"),
        s("containers", "mail", "message/rfc822", b"Subject: Boxes\nFrom: a@b.example\nTo: c@d.example\nContent-Type: text/plain; charset=utf-8\n\nbody line\n", "Subject: Boxes\nFrom: a@b.example\nTo: c@d.example\n\nbody line"),
        s("containers", "mail_html", "message/rfc822", b"Subject: S\nContent-Type: text/html\n\n<p>Hello <b>you</b></p>\n", "Subject: S\n\nHello **you**"),
        s("containers", "zip", "application/zip", zipped({"b.txt": "bee", "a.bin": "?"}), "ZIP Archive (2 files, 4 bytes)\n\nFiles:\n- a.bin (1 bytes)\n- b.txt (3 bytes)\n\nText File Contents:\n\n=== b.txt ===\nbee"),
        s("containers", "tar", "application/x-tar", tarred({"n.md": b"hi"}), "TAR Archive (1 files, 2 bytes)\n\nFiles:\n- n.md (2 bytes)\n\nText File Contents:\n\n=== n.md ===\nhi"),
        s("containers", "png", "image/png", png(30, 20), ""),
        s("containers", "pdf", "application/pdf", b"%PDF-1.4", "Error: no extractor for application/pdf", error="Unsupported"),
        s("containers", "no_type", "", b"x", "Error: no extractor for ", error="Unsupported"),
    )
