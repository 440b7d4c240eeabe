"""OCR layout in HTML and tables in Arrow form to Markdown; the older profile's JSON lines and rendered results."""

from __future__ import annotations

import html.parser
import io
import json
import re
from collections.abc import Iterator


class _Layout(html.parser.HTMLParser):
    """Words of OCR layout: one space between words and lines, an empty line between paragraphs, marks of emphasis kept."""

    MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.mark, self.head, self.skip = "", "", 0

    def close_block(self) -> None:
        if self.line:
            self.blocks.append(self.head + " ".join(self.line))
        self.line, self.head = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kind = dict(attrs).get("class") or ""
        if tag in ("title", "head", "script", "style"):
            self.skip += tag != "head"
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.head = "#" * int(tag[1]) + " "
        elif tag == "p" or "ocr_par" in kind or "ocr_carea" in kind or "ocr_page" in kind:
            self.close_block()
        elif tag in self.MARKS:
            self.mark = self.MARKS[tag]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("title", "script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "p" or tag == "div" or re.fullmatch("h[1-6]", tag):
            self.close_block()
        elif tag in self.MARKS:
            self.mark = ""

    def handle_data(self, data: str) -> None:
        said = " ".join(data.split())
        if said and not self.skip:
            self.line.append(f"{self.mark}{said}{self.mark}")


def hocr_markdown(page: str) -> str:
    """Markdown of OCR output in hOCR; an empty one gives the empty text."""
    p = _Layout()
    p.feed(page)
    p.close()
    p.close_block()
    return "\n\n".join(p.blocks)


def _cell(v) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def arrow_markdown(data: bytes) -> str:
    """A table in Arrow's file or stream form as a pipe table; one without rows or columns gives the empty text."""
    import pyarrow as pa

    source = io.BytesIO(data)
    table = pa.ipc.open_file(source).read_all() if data[:6] == b"ARROW1" else pa.ipc.open_stream(source).read_all()
    if not table.num_rows or not table.num_columns:
        return ""
    lines = ["| " + "".join(f"{n} | " for n in table.column_names), "|" + "------|" * table.num_columns]
    for row in zip(*(c.to_pylist() for c in table.columns)):
        lines.append("| " + "".join(f"{_cell(v)} | " for v in row))
    return "\n".join(lines) + "\n"


def read_hocr(data: bytes) -> tuple[str, dict, list]:
    return hocr_markdown(data.decode("utf-8", "replace")), {"format": "hocr"}, []


def read_arrow(data: bytes) -> tuple[str, dict, list]:
    text = arrow_markdown(data)
    rows = [[c.strip() for c in line.strip().strip("|").split(" | ")] for i, line in enumerate(text.splitlines()) if i != 1]
    return text, {"format": "arrow"}, [rows] if rows else []


# Parts of keys whose values count as text.
TEXT_KEYS = ("title", "name", "subject", "description", "content", "body", "text", "message")


def json_lines(node, nested: bool = True, typed: bool = False, path: str = "") -> Iterator[tuple[str, bool]]:
    """(line, whether it is a text field) of each leaf in the order of the record, by the older profile.

    A field counts as text by its own key, not by its path. Without `nested`, objects within stand as a placeholder;
    with `typed`, lines name the type of their value.
    """
    pairs = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else []
    for k, v in pairs:
        listed = isinstance(node, list)
        own = (f"{path}[{k}]" if path else f"item_{k}") if listed else f"{path}.{k}" if path else str(k)
        if isinstance(v, dict):
            if nested or listed:
                yield from json_lines(v, nested, typed, own)
            else:
                yield f"{own}: [nested object with {len(v)} properties]", False
        elif isinstance(v, list):
            yield from json_lines(v, nested, typed, own)
        elif isinstance(v, str):
            if v.strip():
                yield f"{own} (string): {v}" if typed else f"{own}: {v}", not listed and any(t in str(k).lower() for t in TEXT_KEYS)
        elif v is not None:
            yield f"{own} ({type(v).__name__}): {v}" if typed else f"{own}: {v}", False


def rendered(content: str | None, tables: list[str] | None, metadata: dict | None = None) -> str:
    """A result as one Markdown document: the content, its tables under a heading each, and the metadata if given."""
    parts = [(content or "").rstrip()]
    if tables:
        parts.append("\n\n".join(["## Tables", *[f"### Table {i + 1}\n\n{(t or '').strip() or '_No table data available._'}" for i, t in enumerate(tables)]]))
    if metadata:
        parts.append(f"## Metadata\n\n```json\n{json.dumps(metadata, indent=2, ensure_ascii=False)}\n```")
    return "\n\n".join(p.strip() for p in parts if p.strip())
