"""Queries of small functions: byte validity, OCR words, nested JSON, boundaries, layouts, estimates, entity unions, language support."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.functions import stopwords
from papyra.operators import chunking, entities, tables
from papyra.plans.registry import query
from papyra.plans.text_queries import W
from papyra.session import spread, table
from papyra.sources import files


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


_HEX = "substr(hex(encode(text)), 2 * 97 + 1, 1)"


@query(f"SELECT doc_id, strlen(text) <= 97 OR {_HEX} NOT IN ('8', '9', 'A', 'B') AS valid, strlen(text) > 97 AND {_HEX} IN ('8', '9', 'A', 'B') AS repaired FROM documents WHERE text IS NOT NULL")
def utf8_valid(spark, sf_dir):
    """Whether the first 97 bytes of a text are UTF-8 by themselves, and whether making them so changes them."""
    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.substring(F.col("text").cast("binary"), 1, 97).alias("b"))
    return d.select("doc_id", X.utf8_ok(F.col("b")).alias("valid"), (X.utf8_repaired(F.col("b")).cast("binary") != F.col("b")).alias("repaired"))


@query("SELECT s_suppkey, [s_name] AS words, s_suppkey::INTEGER AS x FROM supplier WHERE s_suppkey % 100 >= 40")
def ocr_words(spark, sf_dir):
    """Words of OCR output that are sure enough: a header line, a line of a paragraph, a word."""
    cells = [F.lit("5"), *[F.lit("1")] * 5, F.col("s_suppkey"), F.col("s_nationkey"), F.lit("30"), F.lit("12"), F.col("s_suppkey") % 100, F.col("s_name")]
    tsv = F.concat(F.lit("level\tpage\n3\t1\t1\t0\t0\t0\t0\t0\t9\t9\t-1\t\n"), F.concat_ws("\t", *[c.cast("string") for c in cells]))
    w = table(spark, sf_dir, "supplier").select("s_suppkey", tables.tsv_words(tsv, 40.0).alias("w")).filter(F.size("w") > 0)
    return w.select("s_suppkey", F.transform("w", lambda x: x["text"]).alias("words"), F.col("w")[0]["left"].alias("x"))


@query("SELECT n_nationkey, 'items[0].k: ' || n_regionkey || chr(10) || 'items[1].k: 7' || chr(10) || 'more.deep.on: true' || chr(10) || 'name: ' || n_name AS lines FROM nation")
def json_nested(spark, sf_dir):
    """Lines of nested records: keys in sorted order, places of arrays, nulls left out."""
    from papyra.sources.extractors import flatten_json

    j = F.to_json(F.struct(F.col("n_name").alias("name"), F.array(F.struct(F.col("n_regionkey").alias("k")), F.struct(F.lit(7).cast("bigint").alias("k"))).alias("items"), F.struct(F.struct(F.lit(True).alias("on"), F.lit(None).cast("string").alias("off")).alias("deep")).alias("more")))
    return table(spark, sf_dir, "nation").select("n_nationkey", j.alias("j")).select("n_nationkey", flatten_json("j").alias("lines"))


_B = "json_transform(CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata), '{') THEN metadata END, '{\"pages\": {\"boundaries\": [{\"byte_start\": \"BIGINT\", \"byte_end\": \"BIGINT\"}]}}').pages.boundaries"


@query(f"""WITH r AS (SELECT DISTINCT result_id, list_filter({_B}, lambda b: b IS NOT NULL AND b.byte_start IS NOT NULL AND b.byte_end IS NOT NULL) AS bs FROM extraction_results)
  SELECT result_id, len(bs)::BIGINT AS n, len(list_filter(bs, lambda b: b.byte_start >= b.byte_end)) = 0 AND len(list_filter(range(1, len(bs)), lambda i: bs[i].byte_end > bs[i + 1].byte_start)) = 0 AS valid FROM r WHERE bs IS NOT NULL""")
def boundaries_valid(spark, sf_dir):
    """Whether the page boundaries of results are ordered and don't overlap."""
    schema = "struct<pages:struct<boundaries:array<struct<byte_start:string,byte_end:string>>>>"
    ok = F.when(X.valid_json(F.col("metadata")) & F.ltrim("metadata").startswith("{"), F.col("metadata"))
    read = F.transform(F.from_json(ok, schema)["pages"]["boundaries"], lambda b: F.named_struct(F.lit("byte_start"), b["byte_start"].try_cast("bigint"), F.lit("byte_end"), b["byte_end"].try_cast("bigint")))
    bs = F.filter(read, lambda b: b["byte_start"].isNotNull() & b["byte_end"].isNotNull())
    r = table(spark, sf_dir, "extraction_results").select("result_id", bs.alias("bs")).filter("bs is not null").distinct()
    return r.select("result_id", F.size("bs").cast("bigint").alias("n"), chunking.boundaries_valid(F.col("bs")).alias("valid"))


def _layout_sql() -> str:
    scores = []
    for name, patterns in entities.CLASSES.items():
        best = " + ".join(f"max(CASE WHEN contains(t, '{p}') THEN w ELSE 0.0 END)" for p in patterns)
        scores.append(f"SELECT doc_id, '{name}' AS document_type, ({best}) / {len(patterns)} AS confidence FROM d GROUP BY doc_id")
    return f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS top, unnest(ls) AS t FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
  d AS (SELECT doc_id, t, CASE WHEN top <= 0.3 * max(top) OVER (PARTITION BY doc_id) THEN 1.5 ELSE 1.0 END AS w FROM l), s AS ({' UNION ALL '.join(scores)})
  SELECT doc_id, document_type, round(confidence::DOUBLE, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(confidence::DOUBLE, 9) DESC, document_type DESC) AS r FROM s) WHERE r = 1"""


@query(_layout_sql())
def layout_type(spark, sf_dir):
    """The class of each document by its lines, those of the top third counting half as much again."""
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("top", "line"))
    return entities.layout_classify(rows, "doc_id", "page", "top", "line").select("doc_id", "document_type", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT doc_id, round(coalesce(strlen(text), 0) / 100000.0 + coalesce(len({W}), 0) / 100.0 + 10 + coalesce(strlen(text), 0) / 10000.0, 6)::DOUBLE AS ms FROM documents")
def processing_estimate(spark, sf_dir):
    """Milliseconds that the default processors take for each document, as they estimate it."""
    from papyra.plans.pipeline import default_processors, estimated_ms

    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.round(estimated_ms(d, default_processors("text")).cast("double"), 6).alias("ms"))


@query(f"""SELECT doc_id, kind, value, count(*) AS n FROM (SELECT doc_id, 'version' AS kind, unnest(regexp_extract_all(text, '{entities.PATTERNS['version']}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) GROUP BY ALL""")
def entity_union(spark, sf_dir):
    """Entities by patterns together with those of another recogniser, here the documents' sources."""
    d = _docs(spark, sf_dir).filter("text is not null")
    own = entities.matches(d, "doc_id", "text", {"version": entities.PATTERNS["version"]})
    other = d.filter("source is not null").select("doc_id", F.lit("source").alias("kind"), F.col("source").alias("value"))
    return entities.union(own, other).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


_KNOWN = ", ".join(f"'{c}'" for c in stopwords.LANGUAGES)


@query(f"SELECT lang, lang IN ({_KNOWN}) AS supported FROM (SELECT DISTINCT lower(trim(lang)) AS lang FROM documents WHERE lang IS NOT NULL)")
def stopword_support(spark, sf_dir):
    """Languages of documents for which stop words are known."""
    d = table(spark, sf_dir, "documents").filter("lang is not null").select(F.lower(F.trim("lang")).alias("lang")).distinct()
    return d.select("lang", stopwords.supported(F.col("lang")).alias("supported"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'text/plain' WHEN n_regionkey = 1 THEN 'text/html' WHEN n_regionkey = 2 THEN 'application/x-nothing' END AS mime_type, CASE WHEN n_regionkey = 2 THEN 'unsupported media type application/x-nothing' WHEN n_regionkey > 2 THEN 'no media type for ' || n_name END AS error FROM nation")
def detect_or_validate(spark, sf_dir):
    """Media types given, by extension, unsupported and unknown."""
    n = table(spark, sf_dir, "nation")
    path = F.concat("n_name", F.when(F.col("n_regionkey") == 0, ".TXT").otherwise(""))
    given = F.when(F.col("n_regionkey") == 1, "text/html").when(F.col("n_regionkey") == 2, "application/x-nothing")
    return n.select("n_nationkey", files.detect_or_validate(path, given).alias("t")).select("n_nationkey", "t.mime_type", "t.error")


@query("SELECT s_suppkey AS input_index, 'p' || s_suppkey AS path, CASE WHEN s_suppkey % 7 = 0 THEN 'FileNotFoundError' END AS error FROM supplier")
def batch_order(spark, sf_dir):
    """Results in the order of their inputs, with a row for each input that isn't there."""
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("path"), F.col("s_suppkey").alias("input_index"))
    there = asked.filter("input_index % 7 <> 0").select("path", F.lit("x").alias("content"), F.lit(None).cast("string").alias("error"))
    both = there.unionByName(files.missing_files(asked, there).select("path", "content", "error"))
    return files.in_input_order(both, asked).select("input_index", "path", "error")
