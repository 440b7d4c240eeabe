"""Extraction of text, metadata and tables from file bytes, one Python function a format, run over Arrow batches.

extract(df) takes rows of (key, path or mime, bytes) and gives one row each: content, mime, metadata (JSON), tables
and error. A file that can't be read becomes a row with "Error: ..." as content and the error's type; it never
stops the batch. Formats whose readers need native libraries (PDF, OCR, .doc, .ppt, .xls, .msg, 7z) come out as
unsupported. Results: null bytes give null content and no error; an empty file gives an empty text.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import re
import tarfile
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from papyra.functions import encoding
from papyra.sources import images, markup
from papyra.sources.mime import BY_EXTENSION

Table = list[list[str]]
Result = tuple[str, dict, list[Table]]

#: Limits of archives: bytes unpacked, ratio, members.
MAX_UNPACKED, MAX_RATIO, MAX_MEMBERS = 500 << 20, 100, 10_000
#: Extensions of archive members that are read as text.
TEXT_MEMBERS = ("txt", "md", "json", "xml", "html", "csv", "log", "yaml", "toml")


class Unsupported(ValueError):
    """No reader for a format."""


def decode(data: bytes, label: str | None = None) -> str:
    """Text of bytes, whatever their encoding; never fails."""
    if label is None:
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            pass
    return encoding.safe_decode(data, label)


def table_markdown(cells: Table) -> str:
    """A pipe table: the first row is the header; short rows are padded, long ones cut; pipes are escaped."""
    if not cells or not cells[0]:
        return ""
    width = len(cells[0])
    line = lambda r: "| " + " | ".join((c or "").replace("|", "\\|") for c in (list(r) + [""] * width)[:width]) + " |"
    return "\n".join([line(cells[0]), "|" + " ------ |" * width, *[line(r) for r in cells[1:]]])


def pipe_tables(text: str) -> list[Table]:
    """Pipe tables of a Markdown text: a header, maybe a separator, rows; empty cells drop; one row is no table."""
    out, rows = [], []
    for line in [*text.split("\n"), ""]:
        s = line.strip()
        if s.startswith("|") and s.endswith("|") and len(s) > 1:
            if not re.fullmatch(r"\|[\s|:\-]+\|", s):
                rows.append([c.strip() for c in s.strip("|").split("|") if c.strip()])
        elif rows:
            if len(rows) > 1:
                out.append(rows)
            rows = []
    return out


# ---------------------------------------------------------------- text formats


def plain(data: bytes) -> Result:
    text = decode(data).rstrip("\n").rstrip("\r")
    return text, {"line_count": len(text.splitlines()), "word_count": len(text.split()), "character_count": len(text.encode())}, []


def markdown(data: bytes) -> Result:
    text, meta = decode(data), {}
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    if m:
        import yaml

        try:
            front = yaml.safe_load(m.group(1))
            meta = {str(k): v if isinstance(v, (str, int, float, bool, list)) else str(v) for k, v in (front or {}).items()} if isinstance(front, dict) else {}
            text = text[m.end() :]
        except yaml.YAMLError:
            pass
    head = re.search(r"^# (.+)$", text, re.M)
    if head and "title" not in meta:
        meta["title"] = head.group(1).strip()
    meta["headers"] = re.findall(r"^#{1,6} +(.+)$", text, re.M)
    meta["links"] = [list(x) for x in re.findall(r"\[([^\]\n]+)\]\(([^)\n]+)\)", text)]
    meta["code_blocks"] = [list(x) for x in re.findall(r"^```(\w*)\n(.*?)^```", text, re.M | re.S)]
    return text, meta, pipe_tables(text)


class _Html(html.parser.HTMLParser):
    """HTML to Markdown: headings, lists, emphasis, links, code, tables; head fields to metadata."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.meta, self.tables, self.skip, self.lists = [], {}, [], 0, []
        self.row = self.cell = self.table = self.href = self.title = None

    def put(self, s: str) -> None:
        if self.cell is not None:
            self.cell.append(s)
        else:
            self.out.append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        elif tag == "title":
            self.title = []
        elif tag == "base":
            self.meta["base-href"] = a.get("href", "")
        elif tag == "link" and a.get("rel") and a.get("href"):
            self.meta["canonical" if a["rel"] == "canonical" else f"link-{a['rel']}"] = a["href"]
        elif tag == "meta" and (a.get("name") or a.get("property")) and "content" in a:
            name = (a.get("name") or a["property"]).lower()
            self.meta[name.replace(":", "_") if name.startswith(("og:", "twitter:")) else f"meta-{name}"] = a["content"]
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "blockquote"):
            self.put("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self.put("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            self.put("\n" + "  " * (len(self.lists) - 1) + ("- " if kind == "ul" else f"{n}. "))
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "code":
            self.put("`")
        elif tag == "a":
            self.href = a.get("href")
            self.put("[" if self.href else "")
        elif tag == "img":
            self.put(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title" and self.title is not None:
            self.meta["title"] = "".join(self.title).strip()
            self.title = None
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "code":
            self.put("`")
        elif tag == "a":
            self.put(f"]({self.href})" if self.href else "")
            self.href = None
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n")
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.table.append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            if self.table:
                self.tables.append(self.table)
                self.out.append("\n\n" + table_markdown(self.table) + "\n\n")
            self.table = None

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif not self.skip:
            self.put(re.sub(r"\s+", " ", data))


def html_text(data: bytes) -> Result:
    p = _Html()
    p.feed(decode(data))
    p.close()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(p.out))).strip()
    return text, p.meta, p.tables


#: Parts of keys whose values count as text.
TEXT_KEYS = ("title", "name", "subject", "description", "content", "body", "text", "message")


def flatten(node, path: str = "") -> Iterator[tuple[str, str]]:
    """path: value of each leaf, keys in sorted order."""
    if isinstance(node, dict):
        for k in sorted(node, key=str):
            yield from flatten(node[k], f"{path}.{k}" if path else str(k))
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from flatten(v, f"{path}[{i}]")
    elif node is not None:
        yield path, {True: "true", False: "false"}.get(node, str(node)) if isinstance(node, bool) else str(node)


def json_schema(node, depth: int = 0) -> dict:
    """Types of a value; of arrays the first item; nothing below depth ten."""
    if depth > 10:
        return {"type": "unknown"}
    if isinstance(node, dict):
        return {"type": "object", "properties": {str(k): json_schema(node[k], depth + 1) for k in sorted(node, key=str)}}
    if isinstance(node, list):
        return {"type": "array", "items": json_schema(node[0], depth + 1) if node else {}, **({"truncated": True} if len(node) > 100 else {})}
    return {"type": "null" if node is None else "boolean" if isinstance(node, bool) else "number" if isinstance(node, (int, float)) else "string"}


def structured(load: Callable[[str], object], form: str) -> Callable[[bytes], Result]:
    def read(data: bytes) -> Result:
        node = load(decode(data))
        pairs = list(flatten(node))
        texts = [p for p, _ in pairs if any(k in p.lower() for k in TEXT_KEYS)]
        return "\n".join(f"{p}: {v}" for p, v in pairs), {"format": form, "text_fields": texts, "json_schema": json_schema(node)}, []

    return read


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def xml_text(data: bytes) -> Result:
    """Text of all elements; names that don't match their ends are read leniently."""
    text = decode(data)
    names = re.findall(r"<([A-Za-z_][\w.:-]*)", re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "", text, flags=re.S))
    body = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", re.sub(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "", text, flags=re.S), flags=re.S)
    parts = [html.unescape(x).strip() for x in re.split(r"<[^>]*>", body)]
    return " ".join(x for x in parts if x), {"element_count": len(names), "unique_elements": sorted(set(names))}, []


def csv_text(sep: str) -> Callable[[bytes], Result]:
    def read(data: bytes) -> Result:
        text, meta, _ = plain(data)
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
        return text, meta, [rows] if len(rows) > 1 else []

    return read


# ---------------------------------------------------------------- mail


def mail(data: bytes) -> Result:
    m = email.message_from_bytes(data, policy=email.policy.default)
    get = lambda k: str(m[k]) if m[k] else None
    text = m.get_body(("plain",))
    rich = m.get_body(("html",))
    body = text.get_content() if text else html_text(rich.get_content().encode())[0] if rich else ""
    files = [a.get_filename() or "" for a in m.iter_attachments()]
    head = [("Subject", get("subject")), ("From", get("from")), ("To", get("to")), ("CC", get("cc")), ("BCC", get("bcc")), ("Date", get("date"))]
    lines = [f"{k}: {v}" for k, v in head if v]
    if files:
        lines.append("Attachments: " + ", ".join(files))
    return "\n".join([*lines, "", body.strip()]).strip(), {"subject": get("subject"), "from_email": get("from"), "message_id": get("message-id"), "attachments": files}, []


# ---------------------------------------------------------------- zipped XML


def _open(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    guard([(i.file_size, i.compress_size) for i in z.infolist()])
    return z


TOO_MANY, TOO_LARGE, TOO_DENSE = "the archive has too many members", "the content is larger than the limit allows", "the archive's compression ratio is above the limit"


def guard(sizes: list[tuple[int, int]]) -> None:
    """Refuse archives that unpack to too much, at too high a ratio, or have too many members."""
    if len(sizes) > MAX_MEMBERS:
        raise ValueError(TOO_MANY)
    if sum(a for a, _ in sizes) > MAX_UNPACKED:
        raise ValueError(TOO_LARGE)
    if any(b and a / b > MAX_RATIO and a > 1 << 20 for a, b in sizes):
        raise ValueError(TOO_DENSE)


def guard_error(members: Column, total: Column, ratio: Column, largest: Column) -> Column:
    """The same of sums that are known already: the error or null."""
    return F.when(members > MAX_MEMBERS, TOO_MANY).when(total > MAX_UNPACKED, TOO_LARGE).when((ratio > MAX_RATIO) & (largest > 1 << 20), TOO_DENSE)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _core(z: zipfile.ZipFile) -> dict:
    out: dict = {}
    for part in ("docProps/core.xml", "docProps/app.xml", "meta.xml"):
        if part in z.namelist():
            for e in ET.fromstring(z.read(part)).iter():
                if e.text and e.text.strip() and not len(e):
                    out.setdefault(_tag(e), e.text.strip())
    if "docProps/custom.xml" in z.namelist():
        for p in ET.fromstring(z.read("docProps/custom.xml")):
            out.setdefault(p.get("name", ""), "".join(p.itertext()))
    return out


def docx(data: bytes) -> Result:
    z = _open(data)
    body = ET.fromstring(z.read("word/document.xml"))[0]
    text, tables = [], []

    def words(e: ET.Element) -> str:
        return "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) == "br" else "" for x in e.iter())

    for e in body:
        if _tag(e) == "p":
            text.append(words(e))
        elif _tag(e) == "tbl":
            rows = [[" ".join(words(p) for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
            tables.append(rows)
            text.append(table_markdown(rows))
    breaks = sum(1 for x in body.iter() if _tag(x) == "br" and any(k.endswith("type") and v == "page" for k, v in x.attrib.items()))
    return "\n\n".join(t for t in text if t), {**_core(z), "page_count": breaks + 1}, tables


def page_boundaries(length: int, breaks: int) -> list[tuple[int, int, int]]:
    """Equal stretches for a text with page breaks whose places aren't known: (start, end, page)."""
    n = breaks + 1
    return [(length * i // n, length * (i + 1) // n if i < n - 1 else length, i + 1) for i in range(n)]


def pptx(data: bytes) -> Result:
    z = _open(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out, tables = [], []
    for i, n in enumerate(slides):
        shapes = []
        for s in ET.fromstring(z.read(n)).iter():
            if _tag(s) in ("sp", "graphicFrame"):
                off = next((x for x in s.iter() if _tag(x) == "off"), None)
                place = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (1 << 30, 0)
                rows = [["".join(x.text or "" for x in c.iter() if _tag(x) == "t") for c in r if _tag(c) == "tc"] for r in s.iter() if _tag(r) == "tr"]
                paras = ["".join(x.text or "" for x in p.iter() if _tag(x) == "t") for p in s.iter() if _tag(p) == "p"]
                if rows:
                    tables.append(rows)
                shapes.append((place, table_markdown(rows) if rows else "\n".join(p for p in paras if p)))
        out.append(f"<!-- Slide {i + 1} -->\n" + "\n".join(t for _, t in sorted(shapes, key=lambda x: x[0]) if t))
        note = n.replace("slides/slide", "notesSlides/notesSlide")
        if note in z.namelist():
            said = "".join(x.text or "" for x in ET.fromstring(z.read(note)).iter() if _tag(x) == "t")
            out.append("### Notes:\n" + said if said else "")
    return "\n\n".join(x for x in out if x), {**_core(z), "slide_count": len(slides)}, tables


def xlsx(data: bytes) -> Result:
    z = _open(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out, tables = [], []
    for name, part in zip(names, parts):
        rows: list[list[str]] = []
        for r in ET.fromstring(z.read(part)).iter():
            if _tag(r) != "row":
                continue
            row: list[str] = []
            for c in r:
                col = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    col = col * 26 + ord(ch) - 64
                while len(row) < col - 1:
                    row.append("")
                v = next((x.text for x in c if _tag(x) == "v"), None)
                kind = c.get("t")
                if kind == "inlineStr":
                    v = "".join(x.text or "" for x in c.iter() if _tag(x) == "t")
                row.append(shared[int(v)] if kind == "s" and v else cell_text(v, kind))
            rows.append(row)
        width = max(map(len, rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows]
        out.append(f"## {name}\n\n{table_markdown(rows)}")
        if rows:
            tables.append(rows)
    return "\n\n".join(out), {**_core(z), "sheet_count": len(names), "sheet_names": sheet_names(names)}, tables


def cell_text(value: str | None, kind: str | None) -> str:
    """Booleans as words, errors marked, whole numbers with one decimal."""
    if value is None:
        return ""
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "e":
        return f"#ERR: {value}"
    try:
        f = float(value)
        return f"{f:.1f}" if f == int(f) and abs(f) < 1e15 else value
    except (ValueError, OverflowError):
        return value


def sheet_names(names: list[str]) -> str:
    return ", ".join(names) if len(names) <= 5 else f"{', '.join(names[:5])}, ... ({len(names)} total)"


def opendocument(data: bytes) -> Result:
    z = _open(data)
    text, tables = [], []

    def rows_of(t: ET.Element) -> Table:
        rows = [["".join(c.itertext()) for c in r if _tag(c) == "table-cell"] for r in t.iter() if _tag(r) == "table-row"]
        width = max(map(len, rows), default=0)
        return [r + [""] * (width - len(r)) for r in rows]

    for body in ET.fromstring(z.read("content.xml")).iter():
        if _tag(body) in ("text", "spreadsheet") and body.tag.endswith(("office:1.0}text", "office:1.0}spreadsheet")):
            for e in body:
                if _tag(e) == "h":
                    text.append("# " + "".join(e.itertext()))
                elif _tag(e) == "p":
                    text.append("".join(e.itertext()))
                elif _tag(e) == "table":
                    tables.append(rows_of(e))
                    text.append(table_markdown(tables[-1]))
    return "\n\n".join(t for t in text if t), _core(z), tables


def epub(data: bytes) -> Result:
    z = _open(data)
    root = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if _tag(e) == "rootfile")
    opf = ET.fromstring(z.read(root))
    base = root.rpartition("/")[0]
    meta = {_tag(e): e.text.strip() for e in opf.iter() if "purl.org/dc" in e.tag and e.text}
    items = {e.get("id"): e.get("href") for e in opf.iter() if _tag(e) == "item"}
    out = []
    for ref in (e.get("idref") for e in opf.iter() if _tag(e) == "itemref"):
        path = "/".join(x for x in (base, items.get(ref, "")) if x)
        if path in z.namelist():
            out.append(re.sub(r"^#+ |[*_`]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", html_text(z.read(path))[0]), flags=re.M))
    return "\n\n".join(x for x in out if x), meta, []


# ---------------------------------------------------------------- markup


def rtf(data: bytes) -> Result:
    """Control words to text; a table's rows by \\cell and \\row; hidden destinations left out."""
    s, out, stack, i, skip = decode(data), [], [], 0, False
    row, rows, tables = [], [], []
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)
    for m in token.finditer(s):
        word, n, hexed, sign, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*":
            skip = True
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"):
            skip = True
        elif skip:
            continue
        elif hexed:
            out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
        elif word == "u" and n:
            out.append(chr(int(n) % 65536))
        elif word in ("par", "line", "sect", "page"):
            out.append("\n")
            if rows:
                tables.append(rows)
                rows = []
        elif word == "tab":
            out.append("\t")
        elif word == "trowd":
            i = len(out)
        elif word == "cell":
            row.append("".join(out[i:]).strip())
            out.append(" ")
            i = len(out)
        elif word == "row":
            rows.append(row)
            row = []
            out.append("\n")
        elif sign and sign in "\\{}":
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif text:
            out.append(text)
    if rows:
        tables.append(rows)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{2,}", "\n\n", "".join(out))).strip(), {}, tables


#: Environments of formulas, which are kept, and of lists.
_FORMULAS = ("equation", "align", "gather", "multline", "displaymath", "eqnarray")
_LISTS = ("itemize", "enumerate", "description")
_BEGIN = re.compile(r"\\begin\{(\w+\*?)\}")
_HEADS = {"chapter": "#", "section": "#", "subsection": "##", "subsubsection": "###"}


def _environment(s: str, name: str, at: int) -> int:
    """Where the matching end of an environment begins; the end of the text if there is none."""
    depth = 1
    for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(s, at):
        depth += 1 if m.group(1) == "begin" else -1
        if not depth:
            return m.start()
    return len(s)


def _latex_line(s: str) -> str:
    """Inline commands: emphasis and unknown ones give their text, formulas stay, settings go."""
    parts = re.split(r"(\$[^$]*\$)", s)
    for i in range(0, len(parts), 2):
        t = re.sub(r"\\(?:usepackage|documentclass|label|ref|cite|pageref|bibliography\w*|maketitle|title|author|date|font)(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "", parts[i])
        t = re.sub(r"\\(?:href)\{([^{}]*)\}\{([^{}]*)\}", r"[\2](\1)", t)
        before = None
        while before != t:  # from the inside out
            before, t = t, re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\([%&_#{}$])", r"\1", t)
        parts[i] = re.sub(r"\\[a-zA-Z]+\*?|\\\\", " ", t).replace("\\", "").replace("~", " ")
    return "".join(parts)


def _latex_list(kind: str, body: str, tables: list[Table], depth: int) -> str:
    out, n = [], 0
    starts = [m for m in re.finditer(r"\\item\b\s*(?:\[([^\]]*)\])?|\\(begin|end)\{(?:itemize|enumerate|description)\}", body)]
    level, items = 0, []
    for m in starts:
        if m.group(2):
            level += 1 if m.group(2) == "begin" else -1
        elif not level:
            items.append(m)
    for i, m in enumerate(items):
        n += 1
        own = _latex_block(body[m.end() : items[i + 1].start() if i + 1 < len(items) else len(body)], tables, depth + 1)
        first, _, rest = own.strip().partition("\n")
        label = f"{m.group(1)}: " if m.group(1) else f"{n}. " if kind == "enumerate" else "- "
        out.append("  " * depth + label + first.strip() + ("\n" + rest if rest.strip() else ""))
    return "\n".join(out)


def _latex_table(body: str, tables: list[Table]) -> str:
    body = re.sub(r"^\s*(?:\[[^\]]*\])?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body))
    rows = [[c for x in r.split("&") if (c := _latex_line(x).strip())] for r in re.split(r"\\\\", body)]
    rows = [r for r in rows if r]
    if rows:
        tables.append(rows)
    return table_markdown(rows)


def _latex_block(s: str, tables: list[Table], depth: int = 0) -> str:
    """Text of a stretch: headings, lists, tables and formulas; any other environment is skipped."""
    out, at = [], 0
    for m in iter(lambda: _BEGIN.search(s, at), None):
        name, end = m.group(1), _environment(s, m.group(1), m.end())
        out.append(_latex_text(s[at : m.start()]))
        body, bare = s[m.end() : end], name.rstrip("*")
        if bare in _LISTS:
            out.append(_latex_list(bare, body, tables, depth))
        elif bare in ("tabular", "tabularx", "longtable"):
            out.append(_latex_table(body, tables))
        elif bare in ("table", "figure", "center"):
            said = [_latex_line(x) for x in re.findall(r"\\caption\{([^{}]*)\}", body)]
            inner = _latex_block(re.sub(r"\\caption\{[^{}]*\}|\\centering|\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", "", body), tables, depth)
            out.append("\n\n".join([*said, inner.strip()]))
        elif bare in _FORMULAS:
            out.append(f"$${body.strip()}$$")
        elif bare in ("verbatim", "lstlisting"):
            out.append("```\n" + body.strip("\n") + "\n```")
        elif bare in ("quote", "quotation", "abstract", "document"):
            out.append(_latex_block(body, tables, depth))
        at = min(len(s), end + len(name) + 6)
    out.append(_latex_text(s[at:]))
    return "\n".join(x for x in out if x.strip())


def _latex_text(s: str) -> str:
    s = re.sub(r"\\(chapter|section|subsection|subsubsection)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: f"\n{_HEADS[m.group(1)]} {m.group(2)}\n", s)
    return _latex_line(s)


def latex(data: bytes) -> Result:
    s = re.sub(r"(?<!\\)%.*", "", decode(data))
    meta = {k: _latex_line(m.group(1)).strip() for k in ("title", "author", "date") if (m := re.search(rf"\\{k}\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", s))}
    m = re.search(r"\\begin\{document\}(.*?)\\end\{document\}", s, re.S) or re.search(r"^(.*?)\\bye", s, re.S)
    tables: list[Table] = []
    text = _latex_block(m.group(1) if m else s, tables)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip(), meta, tables


def rst(data: bytes) -> Result:
    lines, meta, out, tables, i = decode(data).splitlines(), {}, [], [], 0
    while i < len(lines):
        s = lines[i]
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if m := re.match(r":(\w[\w ]*):\s*(.*)", s):
            meta[m.group(1).lower() if m.group(1).lower() in ("author", "date", "version", "title") else f"field_{m.group(1).lower()}"] = m.group(2)
            out.append(m.group(2))
        elif s.strip() and re.fullmatch(r"([=\-~^\"'#*+])\1{2,}", nxt.strip()) and len(nxt.strip()) >= 3:
            meta.setdefault("title", s.strip())
            out.append("# " + s.strip())
            i += 1
        elif m := re.match(r"\.\. (code-block|highlight|image|figure|note|warning|math)::\s*(.*)", s):
            out.append(f"code-block: {m.group(2)}" if m.group(1) in ("code-block", "highlight") else f"image: {m.group(2)}" if m.group(1) in ("image", "figure") else m.group(2))
        elif re.match(r"\.\. ", s):
            pass
        elif s.startswith("+") and re.search(r"[-=]", s) and nxt.startswith("|"):
            rows = []
            while i < len(lines) and lines[i][:1] in "+|" and lines[i]:
                if lines[i][0] == "|":
                    rows.append([c.strip() for c in lines[i].strip("|").split("|")])
                i += 1
            tables.append(rows)
            out.append(table_markdown(rows))
            continue
        elif not re.fullmatch(r"\s*([=\-~^\"'#*+.])\1{2,}\s*", s):
            out.append(s)
        i += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), meta, tables


def org(data: bytes) -> Result:
    meta, out, rows, tables = {}, [], [], []
    for n, s in enumerate([*decode(data).splitlines(), ""]):
        if n < 100 and (m := re.match(r"#\+(\w+):\s*(.*)", s)):
            k = m.group(1).lower()
            meta[k if k in ("title", "author", "date", "keywords") else f"directive_{k}"] = m.group(2)
            continue
        if s.strip().startswith("|"):
            if not re.fullmatch(r"\s*\|[-+|]*", s):
                rows.append([c.strip() for c in s.strip().strip("|").split("|") if c.strip()])
            continue
        if rows:
            tables.append(rows)
            out.append(table_markdown(rows))
            rows = []
        if m := re.match(r"\*+ (.*)", s):
            out.append("# " + m.group(1))
        elif s.strip():
            out.append(s)
    return "\n".join(out), meta, tables


def typst(data: bytes) -> Result:
    s = decode(data)
    meta = {k: m.group(1) for k in ("title", "author", "date", "subject") if (m := re.search(rf'{k}:\s*"([^"]*)"', s))}
    if m := re.search(r"keywords:\s*(?:\"([^\"]*)\"|\(([^)]*)\))", s):
        meta["keywords"] = m.group(1) or ", ".join(re.findall(r'"([^"]*)"', m.group(2)))
    s = re.sub(r"^#(?:set|let|import|include|show)\b.*$", "", s, flags=re.M)
    s = re.sub(r'#link\("([^"]*)"\)\[([^\]]*)\]', r"[\2](\1)", s)
    s = re.sub(r"#table\(", "TABLE:\n", s)
    s = re.sub(r"#\w+(?:\([^)]*\))?\[([^\]]*)\]", r"\1", s)
    s = re.sub(r"^\s*[+-] ", "- ", s, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", s).strip(), meta, []


def bibtex(data: bytes) -> Result:
    """Entries as text; counts, authors, years, types and keys as metadata; a file without entries stays as it is."""
    s, entries = decode(data), []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}", s, re.S):
        fields = {k.lower(): v.strip(" {}\"\n") for k, v in re.findall(r"(\w+)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\"|\d+)", m.group(3))}
        entries.append((m.group(1).lower(), m.group(2), fields))
    if not entries:
        return s, {"entry_count": 0}, []
    authors = sorted({a.strip() for *_, f in entries for a in f.get("author", "").split(" and ") if a.strip()})
    years = [int(f["year"]) for *_, f in entries if f.get("year", "").isdigit()]
    text = "\n\n".join("\n".join([f"{kind}: {key}", *[f"{k}: {v}" for k, v in sorted(f.items())]]) for kind, key, f in entries)
    meta = {"entry_count": len(entries), "authors": authors, "entry_types": dict(sorted(Counter(k for k, *_ in entries).items())), "citation_keys": [k for _, k, _ in entries]}
    return text, meta | ({"year_range": [min(years), max(years)]} if years else {}), []


def notebook(data: bytes) -> Result:
    nb = json.loads(decode(data))
    meta, out = nb.get("metadata", {}), []
    lang = meta.get("language_info", {}).get("name") or meta.get("kernelspec", {}).get("language") or ""
    joined = lambda x: "".join(x) if isinstance(x, list) else x or ""
    for c in nb.get("cells", []):
        src = joined(c.get("source"))
        out.append(f"```{lang}\n{src}\n```" if c.get("cell_type") == "code" else src)
        for o in c.get("outputs", []):
            t = joined(o.get("text")) or joined(o.get("data", {}).get("text/plain"))
            if t:
                out.append(t.rstrip("\n"))
    return "\n\n".join(out), {"kernelspec": meta.get("kernelspec", {}).get("name"), "language": lang, "nbformat": nb.get("nbformat")}, []


def opml(data: bytes) -> Result:
    root = ET.fromstring(data)
    meta = {_tag(e): e.text.strip() for e in root.iter() if _tag(e) in ("title", "dateCreated", "ownerName", "ownerEmail") and e.text}
    out: list[str] = []
    todo = [(e, 0) for b in root if _tag(b) == "body" for e in reversed(list(b))]
    while todo:
        e, depth = todo.pop()
        out.append("  " * depth + (e.get("text") or e.get("title") or ""))
        todo += [(x, depth + 1) for x in reversed(list(e))]
    return "\n".join(out), meta, []


def _sections(data: bytes, title_tags: set[str], para_tags: set[str], code_tags: set[str], skip: set[str]) -> Result:
    """Titles, paragraphs, lists, code and tables of XML books and articles, in document order."""
    root, out, tables, meta = ET.fromstring(data), [], [], {}

    def walk(e: ET.Element, depth: int) -> None:
        t = _tag(e)
        if t in skip or t == "body" and e.get("name") == "notes":
            return
        if t in title_tags:
            said = " ".join("".join(e.itertext()).split())
            if said:
                meta.setdefault("title", said)
                out.append("#" * min(max(depth - 1, 1), 6) + " " + said)
        elif t in code_tags:
            out.append("```\n" + "".join(e.itertext()).strip("\n") + "\n```")
        elif t in ("table", "tgroup", "informaltable"):
            rows = [[" ".join("".join(c.itertext()).split()) for c in r] for r in e.iter() if _tag(r) in ("row", "tr")]
            tables.append(rows)
            out.append(table_markdown(rows))
        elif t in ("listitem", "li", "list-item"):
            out.append("- " + " ".join("".join(e.itertext()).split()))
        elif t in ("blockquote", "cite", "disp-quote", "epigraph"):
            out.append("> " + " ".join("".join(e.itertext()).split()))
        elif t in para_tags:
            out.append(" ".join("".join(e.itertext()).split()))
        else:
            for x in e:
                walk(x, depth + 1)

    walk(root, 0)
    return "\n\n".join(x for x in out if x), meta, tables


def fictionbook(data: bytes) -> Result:
    return _sections(data, {"title", "book-title"}, {"p", "v", "subtitle", "text-author"}, {"code"}, {"binary", "stylesheet"})


def docbook(data: bytes) -> Result:
    """The first title heads the text; later ones are of the second level; lists, code, quotes, figures and tables in order."""
    root, out, tables, meta = ET.fromstring(data), [], [], {}
    said = lambda e: " ".join("".join(e.itertext()).split())

    def walk(e: ET.Element) -> None:
        t = _tag(e)
        if t == "indexterm":
            return
        if t == "title":
            if "title" not in meta:
                meta["title"] = said(e)
            out.append(("# " if len(out) == 0 else "## ") + said(e))
        elif t in ("para", "simpara"):
            out.append(said(e))
        elif t in ("programlisting", "screen"):
            out.append("```\n" + "".join(e.itertext()).strip("\n") + "\n```")
        elif t in ("itemizedlist", "orderedlist"):
            items = [said(x) for x in e if _tag(x) == "listitem"]
            out.append("\n".join(f"{i + 1}. {x}" if t == "orderedlist" else f"- {x}" for i, x in enumerate(items)))
        elif t == "variablelist":
            out.append("\n".join(f"{said(x[0])}: " + " ".join(said(y) for y in x[1:]) for x in e if _tag(x) == "varlistentry" and len(x)))
        elif t in ("blockquote", "epigraph"):
            out.append("> " + said(e))
        elif t in ("figure", "mediaobject"):
            out.append("**Figure:** " + said(e))
        elif t in ("table", "informaltable", "tgroup"):
            rows = [[said(c) for c in r] for r in e.iter() if _tag(r) in ("row", "tr")]
            if rows:
                tables.append(rows)
                out.append("\n\n".join([*[f"**{said(x)}**" for x in e if _tag(x) in ("title", "caption")], table_markdown(rows)]))
        else:
            if t in ("author", "date", "copyright", "abstract", "subjectset") and said(e):
                meta.setdefault(t, said(e))
                if t != "abstract":
                    return
            for x in e:
                walk(x)

    walk(root)
    return "\n\n".join(x for x in out if x), meta, tables


def jats(data: bytes) -> Result:
    return _sections(data, {"article-title", "title"}, {"p"}, {"code"}, {"ref-list", "journal-meta"})


# ---------------------------------------------------------------- archives


def _archive(form: str, members: list[tuple[str, int, bool]], read: Callable[[str], bytes]) -> Result:
    lines, texts = [f"{form} Archive ({len(members)} files, {sum(s for _, s, d in members if not d)} bytes)", "", "Files:"], []
    for name, size, is_dir in sorted(members):
        lines.append(f"- {name}" + ("" if is_dir else f" ({size} bytes)"))
        if not is_dir and name.rpartition(".")[2].lower() in TEXT_MEMBERS:
            try:
                texts.append(f"=== {name} ===\n{read(name).decode('utf-8')}")
            except UnicodeDecodeError:
                pass
    body = "\n".join(lines) + ("\n\nText File Contents:\n\n" + "\n\n".join(texts) if texts else "")
    return body, {"format": form, "file_count": len(members), "total_size": sum(s for _, s, d in members if not d), "file_list": [n for n, *_ in sorted(members)]}, []


def zip_archive(data: bytes) -> Result:
    z = _open(data)
    return _archive("ZIP", [(i.filename, i.file_size, i.is_dir()) for i in z.infolist()], z.read)


def tar_archive(data: bytes) -> Result:
    t = tarfile.open(fileobj=io.BytesIO(data))
    members = t.getmembers()
    guard([(m.size, 0) for m in members])
    return _archive("TAR", [(m.name, m.size, m.isdir()) for m in members], lambda n: t.extractfile(n).read())


# ---------------------------------------------------------------- dispatch

READERS: dict[str, Callable[[bytes], Result]] = {
    "text/plain": plain, "text/markdown": markdown, "text/x-markdown": markdown, "text/x-gfm": markdown, "text/x-commonmark": markdown, "text/html": html_text, "application/xhtml+xml": html_text,
    "application/json": structured(json.loads, "json"), "text/json": structured(json.loads, "json"), "application/x-yaml": structured(_yaml, "yaml"), "text/yaml": structured(_yaml, "yaml"), "application/yaml": structured(_yaml, "yaml"),
    "application/toml": structured(tomllib.loads, "toml"), "text/toml": structured(tomllib.loads, "toml"), "application/xml": xml_text, "text/xml": xml_text, "image/svg+xml": xml_text,
    "text/csv": csv_text(","), "text/tab-separated-values": csv_text("\t"), "message/rfc822": mail,
    BY_EXTENSION["docx"]: docx, BY_EXTENSION["pptx"]: pptx, BY_EXTENSION["xlsx"]: xlsx, BY_EXTENSION["xlsm"]: xlsx, BY_EXTENSION["odt"]: opendocument, BY_EXTENSION["ods"]: opendocument,
    "application/epub+zip": epub, "application/rtf": rtf, "application/x-latex": latex, "text/x-rst": rst, "text/x-org": org, "application/x-typst": typst, "application/x-bibtex": bibtex, "application/x-biblatex": bibtex,
    "application/x-ipynb+json": notebook, "application/x-opml+xml": opml, "application/xml+opml": opml, "text/x-opml": opml, "application/x-fictionbook+xml": fictionbook, "application/docbook+xml": docbook, "application/x-jats+xml": jats,
    **{f"image/{k}": images.read_image for k in ("png", "jpeg", "jpg", "gif", "bmp", "webp", "tiff", "tif")}, "text/x-hocr": markup.read_hocr, "application/vnd.apache.arrow.file": markup.read_arrow, "application/vnd.apache.arrow.stream": markup.read_arrow,
    "application/zip": zip_archive, "application/x-zip-compressed": zip_archive, "application/x-tar": tar_archive, "application/gzip": tar_archive,
}


def read_one(data: bytes | None, mime: str | None, readers: dict[str, Callable[[bytes], Result]] | None = None) -> tuple[str | None, str, str, list, str | None]:
    """(content, mime, metadata, tables, error) of one file; errors become data."""
    if data is None:
        return None, mime or "", "{}", [], None
    own = readers or READERS
    try:
        reader = own.get(mime or "") or own.get((mime or "").partition("/")[0] + "/*")
        if reader is None:
            raise Unsupported(f"no extractor for {mime}")
        text, meta, tables = reader(bytes(data))
        return text, mime or "", json.dumps(meta, default=str, ensure_ascii=False), [[[str(c) for c in r] for r in t] for t in tables], None
    except Exception as ex:  # noqa: BLE001 - any failure of a reader is this row's error
        return f"Error: {ex}", "text/plain", json.dumps({"error": {"error_type": type(ex).__name__, "message": str(ex)}}), [], type(ex).__name__


SCHEMA = "content string, mime string, metadata string, tables array<array<array<string>>>, error string"


def extract(df: DataFrame, keep: list[str], data: str = "data", mime: str = "mime_type", readers: dict | None = None) -> DataFrame:
    """The kept columns and SCHEMA for each row; one pass over Arrow batches, whatever the mix of formats."""
    kinds = dict(df.dtypes)
    fields = [("content", pa.string()), ("mime", pa.string()), ("metadata", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = [read_one(d, m, readers) for d, m in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist())]
                cols = [pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], [*keep, *[f for f, _ in fields]])

    return df.select(*keep, data, mime).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [SCHEMA]))


@pandas_udf(StringType())
def _flatten_json(s):
    def one(t):
        try:
            return "\n".join(f"{p}: {v}" for p, v in flatten(json.loads(t)))
        except (ValueError, TypeError, RecursionError):
            return None

    return s.map(one)


def flatten_json(column: str) -> Column:
    """path: value lines of a JSON text, keys sorted; null for what isn't JSON."""
    return _flatten_json(F.col(column))
