"""Tables: rendering, summaries, structure, and reconstruction from positioned words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def markdown(cells: Column) -> Column:
    """A pipe table: header, rule, rows padded or cut to the header's width; null cells are empty, pipes are escaped."""
    width = F.size(cells[0])

    def line(row: Column) -> Column:
        full = F.slice(F.concat(F.coalesce(row, F.array().cast("array<string>")), F.array_repeat(F.lit(""), width)), F.lit(1), width)
        return F.concat(F.lit("| "), F.array_join(F.transform(full, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" ------ |"), width), ""))
    rows = F.transform(cells, line)
    text = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))), "\n")
    return F.when(cells.isNull() | (F.size(cells) == 0) | (width <= 0), F.lit("")).otherwise(text)


def rendered(content: Column, shown: Column, metadata: Column) -> Column:
    """A result as one Markdown document: content, tables under numbered headings, metadata as JSON; empty parts are left out."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    part = lambda c: F.nullif(trim(F.coalesce(c, F.lit(""))), F.lit(""))
    each = F.transform(shown, lambda t, i: F.concat(F.lit("### Table "), (i + 1).cast("string"), F.lit("\n\n"), F.coalesce(part(t), F.lit("_No table data available._"))))
    listed = F.when(F.size(shown) > 0, F.concat(F.lit("## Tables\n\n"), F.array_join(each, "\n\n")))
    meta = F.when(metadata != "", F.concat(F.lit("## Metadata\n\n```json\n"), metadata, F.lit("\n```")))
    return F.concat_ws("\n\n", part(content), listed, meta)


def csv_line(row: Column, sep: str = ",") -> Column:
    """One row as delimited text; cells with quotes, separators or line feeds are quoted."""
    quote = lambda c: F.when(c.rlike(f'["{sep}\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(row, lambda c: quote(F.coalesce(c, F.lit("")))), sep)


def drop_empty(cells: Column) -> Column:
    """A grid without empty rows and without columns that are empty throughout."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: ~blank(c)))
    width = F.greatest(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), F.lit(1))
    keep = F.filter(F.sequence(F.lit(1), width), lambda i: F.exists(rows, lambda r: ~blank(F.try_element_at(r, i))))
    return F.transform(rows, lambda r: F.transform(keep, lambda i: F.coalesce(F.try_element_at(r, i), F.lit(""))))


def structure(cells: Column) -> dict[str, Column]:
    """Rows, columns, empty cells, numeric columns and density of a table."""
    body = F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))
    width = F.size(cells[0])
    flat = F.flatten(cells)
    empty = F.size(F.filter(flat, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""))
    column = lambda i: F.filter(F.transform(body, lambda r: F.try_element_at(r, i)), lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    numeric = F.size(F.filter(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: (F.size(column(i)) > 0) & F.forall(column(i), lambda c: c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))))
    return {
        "n_rows": F.size(body).cast("bigint"), "n_cols": width.cast("bigint"), "n_empty": empty.cast("bigint"), "n_numeric": numeric.cast("bigint"),
        "density": F.when(F.size(flat) > 0, F.round(1 - empty / F.greatest(F.size(flat), F.lit(1)), 6)).otherwise(F.lit(0.0)),
    }


def group_characters(chars: DataFrame, page: str) -> DataFrame:
    """Characters (page, seq, x, y, width, height, ch) to words (page, word_no, text, left, top, right, bottom).

    A word ends at white space, at a step of more than half the height before, or at a gap of more than three units.
    """
    by = Win.partitionBy(page).orderBy("seq")
    prev = lambda c: F.lag(c).over(by)
    new = (F.abs(F.col("y") - prev("y")) > 0.5 * prev("height")) | (F.col("x") - (prev("x") + prev("width")) > 3.0) | (F.trim(prev("ch")) == "")
    marked = chars.withColumn("word_no", F.sum(F.when(new, 1).otherwise(0)).over(by)).filter(F.trim("ch") != "")
    return marked.groupBy(page, "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda s: s["ch"]), "").alias("text"),
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
    )


def column_positions(words: DataFrame, page: str, gap: float = 20.0) -> DataFrame:
    """(page, column_no, position): clusters of left edges; a gap above the threshold opens a new one; the median stands for it."""
    edges = words.select(page, "left").distinct()
    by = Win.partitionBy(page).orderBy("left")
    step = F.col("left") - F.lag("left").over(by)
    marked = edges.withColumn("column_no", F.sum(F.when(step > gap, 1).otherwise(0)).over(by))
    return marked.groupBy(page, "column_no").agg(F.percentile("left", F.lit(0.5)).cast("int").alias("position"))


def row_positions(tops: list[float], limit: float) -> list[float]:
    """Clusters of tops by the running mean of the cluster so far, in order; the mean stands for each."""
    rows: list[list[float]] = []
    for top in sorted(tops):
        if rows and top - sum(rows[-1]) / len(rows[-1]) <= limit:
            rows[-1].append(top)
        else:
            rows.append([top])
    return [sum(r) / len(r) for r in rows]


def nearest(place: Column, places: Column) -> Column:
    """Number of the nearest of some places, from 0; the first of equals."""
    return F.array_min(F.transform(places, lambda p, i: F.struct(F.abs(p - place).alias("d"), i.alias("i"))))["i"]


def reconstruct(words: DataFrame, page: str, column_gap: float = 20.0, row_ratio: float = 0.5) -> DataFrame:
    """(page, row_no, cells): a grid from positioned words (page, text, left, top, height), page by page.

    Columns are the clusters of column_positions; rows cluster by the running mean of their tops, which depends on
    order, so the tops of a page are worked on together (a page is small). Words go to the nearest row and column by an
    array expression; words of a cell join in order of their places.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import ArrayType, DoubleType

    @pandas_udf(ArrayType(DoubleType()))
    def clustered(tops: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([row_positions(list(t), x) for t, x in zip(tops, limit)])

    w = words.select(page, "text", "left", "top", "height")
    columns = column_positions(w, page, column_gap).groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("column_no", "position"))), lambda x: x["position"].cast("double")).alias("columns"))
    rows = w.groupBy(page).agg(F.collect_list(F.col("top").cast("double")).alias("tops"), (F.avg("height") * row_ratio).alias("limit")).select(page, clustered("tops", "limit").alias("rows"))
    placed = w.join(columns.join(rows, page), page).select(page, "text", "left", "top", "columns", "rows", nearest(F.col("top"), F.col("rows")).alias("row_no"), nearest(F.col("left"), F.col("columns")).alias("column_no"))
    cells = placed.groupBy(page, "row_no", "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ").alias("cell"), F.first(F.size("columns")).alias("n"))
    grid = cells.groupBy(page, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column_no", "cell"))).alias("m"), F.first("n").alias("n"))
    return grid.select(page, F.col("row_no").cast("int").alias("row_no"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(""))).alias("cells"))


def reconstructed_markdown(words: DataFrame, page: str, column_gap: float = 20.0, row_ratio: float = 0.5) -> DataFrame:
    """(page, markdown): the rebuilt grid of each page as a pipe table, without empty rows and columns."""
    rows = reconstruct(words, page, column_gap, row_ratio)
    grid = rows.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("cells"))
    return grid.select(page, markdown(drop_empty(F.col("cells"))).alias("markdown"))


def tsv_words(tsv: Column, min_confidence: float = 0.0) -> Column:
    """Words of OCR output in twelve tab-separated columns: level five, confident enough, not blank."""
    rows = F.transform(F.slice(F.split(tsv, "\n"), F.lit(2), F.greatest(F.size(F.split(tsv, "\n")), F.lit(1))), lambda x: F.split(x, "\t"))
    good = F.filter(rows, lambda r: (F.size(r) >= 12) & (r[0] == "5") & (r[10].try_cast("double") >= min_confidence) & (F.trim(r[11]) != ""))
    return F.transform(good, lambda r: F.named_struct(F.lit("text"), r[11], *[x for i, n in ((6, "left"), (7, "top"), (8, "width"), (9, "height")) for x in (F.lit(n), r[i].try_cast("int"))], F.lit("confidence"), r[10].try_cast("double")))
