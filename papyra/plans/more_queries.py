"""Queries of OCR language support, metadata normalisation, spreadsheet complexity, resource guards and XML counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.plans.registry import query
from papyra.session import table

# Languages that OCR backends support, of those in the data.
OCR_LANGUAGES = {"tesseract": ["deu", "eng", "fra", "ita", "jpn", "nld", "pol", "por", "rus", "spa"], "easyocr": ["de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru"], "paddleocr": ["en", "french", "german", "japan", "korean"]}
_PAIRS = [(b, c) for b, cs in OCR_LANGUAGES.items() for c in cs]


@query(f"""WITH o(backend, code) AS (VALUES {", ".join(f"('{b}', '{c}')" for b, c in _PAIRS)}), l AS (SELECT lower(trim(unnest(detected_languages))) AS code, result_id FROM extraction_results)
  SELECT o.backend, count(DISTINCT l.result_id) AS results, count(DISTINCT l.code) AS codes FROM o JOIN l USING (code) GROUP BY o.backend""")
def ocr_support(spark, sf_dir):
    """Results whose languages a backend supports: a join with a small registry."""
    o = spark.createDataFrame(_PAIRS, "backend string, code string")
    r = table(spark, sf_dir, "extraction_results").select("result_id", F.explode("detected_languages").alias("c")).select("result_id", F.lower(F.trim("c")).alias("code"))
    return r.join(o, "code").groupBy("backend").agg(F.countDistinct("result_id").alias("results"), F.countDistinct("code").alias("codes"))





@query("""WITH t AS (SELECT result_id, unnest(tables[:3]) AS t FROM (SELECT * FROM extraction_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1))
  SELECT result_id, sum(len(list_filter(flatten(t.cells[:50]), lambda c: c IS NOT NULL AND trim(c) <> '')))::BIGINT AS filled, bool_or(len(list_filter(flatten(t.cells), lambda c: starts_with(c, '='))) > 0) AS formulas FROM t WHERE t.cells IS NOT NULL GROUP BY result_id""")
def sheet_complexity(spark, sf_dir):
    """Filled cells in the first fifty rows of the first three sheets, and whether there are formulas: the feature looks at no more."""
    t = table(spark, sf_dir, "extraction_results").dropDuplicates(["result_id"]).select("result_id", F.explode(F.slice("tables", 1, 3)).alias("t")).filter("t.cells is not null")
    filled = F.size(F.filter(F.flatten(F.slice("t.cells", 1, 50)), lambda c: c.isNotNull() & (F.trim(c) != "")))
    formula = F.size(F.filter(F.flatten("t.cells"), lambda c: c.startswith("="))) > 0
    return t.groupBy("result_id").agg(F.sum(filled).cast("bigint").alias("filled"), F.bool_or(formula).alias("formulas"))



@query("""WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
  f AS (SELECT doc_id, i, part, sum(CASE WHEN starts_with(part, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM s)
  SELECT doc_id, count(*) FILTER (WHERE fences % 2 = 1 AND NOT starts_with(part, '```')) AS code_lines, count(*) AS all_lines FROM f GROUP BY doc_id""")
def code_lines(spark, sf_dir):
    """Lines inside fenced code: a running count of fences within each document."""
    from pyspark.sql import Window as Win

    p = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "part"))
    fence = F.col("part").startswith("```")
    by = Win.partitionBy("doc_id").orderBy("i").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    f = p.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(by))
    return f.groupBy("doc_id").agg(F.count_if((F.col("fences") % 2 == 1) & ~fence).alias("code_lines"), F.count("*").alias("all_lines"))
