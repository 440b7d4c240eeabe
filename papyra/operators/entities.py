"""Entities by patterns, document classes by patterns, and codes of error messages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: Default patterns of entities; ASCII classes, the same in every engine.
PATTERNS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "money": r"(?:EUR|[£$]) ?[0-9]+\.[0-9]{2}",
    "url": r"https?://[A-Za-z0-9./?=&_%#-]+",
    "version": r"[0-9]+\.[0-9]+\.[0-9]+",
}

# Patterns of document classes.
CLASSES = {
    "invoice": ["invoice", "bill to", "invoice number", "total amount", "tax id"],
    "receipt": ["receipt", "cash receipt", "payment", "subtotal", "total due"],
    "contract": ["agreement", "contract", "party a", "party b", "terms and conditions", "signature"],
    "report": ["report", "summary", "analysis", "findings", "conclusion"],
    "form": ["form", "fill out", "signature", "date", "submit"],
}
THRESHOLD = 0.5

#: Codes of error messages by words they have, first match first.
ERROR_CODES = [("password", "password"), ("unsupported", "no extractor|unsupported"), ("limit", "limit|larger than"), ("archive", "archive"), ("ocr", "ocr|image"), ("io", "no such file|permission|read"), ("parsing", "parse|decode|invalid")]


def matches(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, value): one row for each match of each pattern, on the JVM side; nothing for null texts."""

    def own(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.array(*[own(k, p) for k, p in patterns.items()])
    return df.filter(F.col(text).isNotNull()).select(key, F.explode(F.flatten(found)).alias("e")).select(key, "e.kind", "e.value")


def union(*found: DataFrame) -> DataFrame:
    """The entities of several recognisers, all of them, in one frame; columns that one lacks are null."""
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def spans(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, value, char_start, char_end): matches with their places."""
    kind = dict(df.dtypes)[key]
    compiled = {k: re.compile(p) for k, p in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values, start, end = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, p in compiled.items() if t else ():
                    for m in p.finditer(t):
                        at.append(i)
                        kinds.append(k)
                        values.append(m.group())
                        start.append(m.start())
                        end.append(m.end())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [key, "kind", "value", "char_start", "char_end"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, value string, char_start int, char_end int")


def with_values(text: Column, *values: Column) -> Column:
    """A text and the values of its metadata, which count for its class as well."""
    return F.concat_ws(" ", text, *values)


def class_scores(text: Column) -> Column:
    """An array of (confidence, document_type): patterns of the class in the text, as a share of the class's."""
    t = F.lower(text)

    def score(name: str) -> Column:
        hits = sum((F.when(t.contains(p), 1).otherwise(0) for p in CLASSES[name]), F.lit(0))
        return F.struct((hits / F.lit(len(CLASSES[name]))).alias("confidence"), F.lit(name).alias("document_type"))

    return F.array(*[score(name) for name in sorted(CLASSES)])


def classify(text: Column) -> Column:
    """The class with the highest share; of equals the first by name."""
    better = lambda a, b: F.when(b["confidence"] > a["confidence"], b).otherwise(a)
    none = F.struct(F.lit(-1.0).alias("confidence"), F.lit("").alias("document_type"))
    return F.aggregate(class_scores(text), none, better)


def layout_classify(rows: DataFrame, key: str, page: str, top: str, text: str) -> DataFrame:
    """(key, document_type, confidence) from positioned rows: a match in the top third of its page counts half as much again."""
    high = F.max(top).over(Win.partitionBy(key, page))
    placed = rows.withColumn("weight", F.when(F.col(top) <= high * 0.3, 1.5).otherwise(1.0))
    hits = [(name, p) for name in sorted(CLASSES) for p in CLASSES[name]]
    best = placed.groupBy(key).agg(*[F.max(F.when(F.lower(text).contains(p), F.col("weight")).otherwise(0.0)).alias(f"h{i}") for i, (_, p) in enumerate(hits)])
    scores = F.array(*[F.struct((sum((F.col(f"h{i}") for i, (n, _) in enumerate(hits) if n == name), F.lit(0.0)) / len(CLASSES[name])).alias("confidence"), F.lit(name).alias("document_type")) for name in sorted(CLASSES)])
    return best.select(key, F.array_max(scores).alias("b")).select(key, "b.document_type", "b.confidence")


def error_code(message: Column) -> Column:
    out = F.when(message.isNull(), "none")
    for name, p in ERROR_CODES:
        out = out.when(F.lower(message).rlike(p), name)
    return out.otherwise("unknown")
