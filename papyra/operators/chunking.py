"""Chunks of texts: the recursive splitter, derived offsets, boundaries and page ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

_LEVELS = [re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?。])\s+"), re.compile(r"\s+")]


#: Boundaries of Markdown, the coarsest first: headings by level, rules, blocks, then those of plain text.
_MARKDOWN = [*(re.compile(rf"\n(?=#{{1,{n}}} )") for n in range(1, 7)), re.compile(r"\n(?=(?:-{3,}|\*{3,}|_{3,})[ \t]*\n)"), re.compile(r"\n\s*\n"), re.compile(r"\n(?=[ \t]*(?:[-*+]|\d+[.)]) )"), *_LEVELS[1:]]


def split_markdown(text: str, size: int = 1000, overlap: int = 200, trim: bool = True) -> list[str]:
    """As split_text, at headings, rules, blocks and items first; fenced code is kept whole where it fits."""
    fences = [m.span() for m in re.finditer(r"^(```|~~~).*?^\1[ \t]*$", text, re.M | re.S) if m.end() - m.start() <= size]
    return split_text(text, size, overlap, trim, _MARKDOWN, fences)


def utf8_boundary(text: Column, place: Column) -> Column:
    """Whether a place in the UTF-8 bytes of a text lies between characters."""
    data = text.cast("binary")
    first = F.substring(F.hex(F.substring(data, (place + 1).cast("int"), F.lit(1))), 1, 1)
    return (place >= 0) & (place <= F.octet_length(data)) & ((place == F.octet_length(data)) | ~first.isin("8", "9", "A", "B"))


def split_text(text: str, size: int = 1000, overlap: int = 200, trim: bool = True, levels: list[re.Pattern] = _LEVELS, whole: list[tuple[int, int]] | None = None) -> list[str]:
    """Pieces of at most `size` characters at the coarsest boundaries that fit, neighbours merged greedily.

    The next piece begins up to `overlap` characters back, at a word. Empty texts give none.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the size")

    def atoms(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
        elif level == len(levels):
            for i in range(a, b, size):
                yield i, min(b, i + size)
        else:
            last = a
            for m in [*levels[level].finditer(text, a, b), None]:
                end = m.end() if m else b
                if m and any(x < end < y for x, y in whole or ()):
                    continue
                if end > last:
                    yield from atoms(last, end, level + 1)
                    last = end

    out, start, end = [], None, None
    for a, b in atoms(0, len(text), 0):
        if start is None:
            start, end = a, b
        elif b - start <= size:
            end = b
        else:
            out.append((start, end))
            back = max(start + 1, end - overlap)
            m = re.compile(r"\s+").search(text, back, end) if overlap else None
            start = m.end() if m and b - m.end() <= size else a
            end = b
    if start is not None:
        out.append((start, end))
    pieces = [text[a:b].strip() if trim else text[a:b] for a, b in out]
    return [p for p in pieces if p]


def chunk(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, kind_of: str = "text") -> DataFrame:
    """(key, chunk_index, content); kind_of is text or markdown."""
    split = split_markdown if kind_of == "markdown" else split_text
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, parts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for j, p in enumerate(split(t or "", size, overlap)):
                    at.append(i)
                    no.append(j)
                    parts.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(parts, pa.string())], [key, "chunk_index", "content"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_index int, content string")


def with_offsets(chunks: DataFrame, key: str, overlap: int) -> DataFrame:
    """Derived byte offsets, index and total: each chunk begins where the one before ended, less the overlap."""
    by = Win.partitionBy(key).orderBy("chunk_index")
    size = F.octet_length("content").cast("bigint")
    before = F.coalesce(F.sum(size - F.least(F.lit(overlap), size)).over(by.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumns({"byte_start": before, "byte_end": before + size, "total_chunks": F.count("*").over(Win.partitionBy(key))})


def page_range(start: Column, end: Column, boundaries: Column) -> Column:
    """struct(first_page, last_page) of the boundaries a half-open byte range overlaps; nulls where there are none."""
    hit = F.filter(boundaries, lambda b: (start < b["byte_end"]) & (end > b["byte_start"]))
    return F.struct(F.try_element_at(hit, F.lit(1))["page_number"].alias("first_page"), F.try_element_at(hit, F.lit(-1))["page_number"].alias("last_page"))


def boundaries_valid(boundaries: Column) -> Column:
    """Whether page boundaries are ordered, none empty and none overlapping the one before."""
    n = F.size(boundaries)
    ordered = F.forall(boundaries, lambda b: b["byte_start"] < b["byte_end"])
    apart = F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(boundaries, i)["byte_end"] <= F.element_at(boundaries, i + 1)["byte_start"])
    return F.when(n <= 1, ordered).otherwise(ordered & apart)
