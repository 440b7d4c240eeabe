"""Queries that run extraction and reduction over documents: formats derived from the texts, archives, reduction levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import reduce, text as X
from papyra.operators import tables
from papyra.plans.registry import query
from papyra.plans.structure_queries import _with_stop
from papyra.sources import extractors
from papyra.session import spread, table


def _as_files(spark, sf_dir):
    """Every document as HTML, JSON, Markdown and mail bytes: four files each."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").filter("text is not null")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.coalesce("source", F.lit("none"))
    page = F.concat(F.lit("<html><head><title>"), title, F.lit('</title><meta name="author" content="x"></head><body><h1>'), title, F.lit("</h1><p>"), safe, F.lit("</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"))
    forms = {
        "text/html": page,
        "application/json": F.to_json(F.struct(title.alias("title"), F.col("text").alias("body"), F.struct("lang").alias("more"))),
        "text/markdown": F.concat(F.lit("---\ntitle: t\n---\n# "), title, F.lit("\n\n"), F.col("text")),
        "message/rfc822": F.concat(F.lit("Subject: "), title, F.lit("\nFrom: a@example.org\nTo: b@example.org\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text")),
        "application/pdf": F.lit("%PDF-1.4"),
    }
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("mime_type"), v.cast("binary").alias("data")) for k, v in forms.items()]))
    return d.select("doc_id", kinds.alias("f")).select("doc_id", "f.mime_type", "f.data")


@query("""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS s FROM documents WHERE text IS NOT NULL), k(asked, mime, n_tables, error) AS (VALUES ('text/html', 'text/html', 1, NULL), ('application/json', 'application/json', 0, NULL), ('message/rfc822', 'message/rfc822', 0, NULL), ('application/pdf', 'text/plain', 0, 'Unsupported'))
  SELECT doc_id, asked, mime, n_tables::INTEGER AS n_tables, CASE WHEN asked = 'text/html' THEN trim(s) END AS title, error FROM d, k""")
def extract_formats(spark, sf_dir):
    """Media type, tables, title and error of four forms of every document; the Markdown form is in markdown_structure."""
    files = _as_files(spark, sf_dir).filter("mime_type <> 'text/markdown'")
    out = extractors.extract(files.withColumn("asked", F.col("mime_type")), ["doc_id", "asked"])
    return out.select("doc_id", "asked", "mime", F.size("tables").alias("n_tables"), F.get_json_object("metadata", "$.title").alias("title"), "error")


@query("""SELECT asked, count(*) AS n, count(error) AS errors FROM (SELECT unnest(['text/html', 'application/json', 'text/markdown', 'message/rfc822', 'application/pdf']) AS asked, doc_id FROM documents WHERE text IS NOT NULL) s
  LEFT JOIN (SELECT 'application/pdf' AS kind, 'Unsupported' AS error) e ON e.kind = s.asked GROUP BY asked""")
def extract_errors(spark, sf_dir):
    """A format without a reader gives rows with an error and stops nothing."""
    out = extractors.extract(_as_files(spark, sf_dir).withColumn("asked", F.col("mime_type")), ["doc_id", "asked"])
    return out.groupBy("asked").agg(F.count("*").alias("n"), F.count("error").alias("errors"))



def _level(level: str):
    def run(spark, sf_dir):
        return reduce.reduce(_with_stop(spark, sf_dir), "doc_id", "text", "stop", level)

    run.__name__ = f"reduce_{level}"
    return query()(run)


reduce_aggressive, reduce_maximum = _level("aggressive"), _level("maximum")


@query("SELECT doc_id, length(nfc_normalize(text))::BIGINT AS n, text <> nfc_normalize(text) AS changed FROM documents")
def unicode_nfc(spark, sf_dir):
    """Composed form of texts; ASCII texts stay on the JVM side."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import StringType

    @pandas_udf(StringType())
    def nfc(s):
        return s.map(lambda t: None if t is None else reduce.nfc(t))

    t = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = t.filter("text is null or length(text) = octet_length(text)").withColumn("nfc", F.col("text"))
    d = plain.unionByName(t.filter("length(text) <> octet_length(text)").withColumn("nfc", nfc("text")))
    return d.select("doc_id", F.length("nfc").cast("bigint").alias("n"), (F.col("text") != F.col("nfc")).alias("changed"))


@query("""WITH c AS (SELECT c_custkey, unnest(range(1, length(c_name) + 1)) AS i, c_name FROM customer), g AS (SELECT c_custkey, i, substr(c_name, i::INT, 1) AS ch, (i - 1) * 6 + CASE WHEN substr(c_name, i::INT, 1) = '#' THEN 9 ELSE 0 END AS x FROM c),
  n AS (SELECT *, CASE WHEN x - (lag(x) OVER w + 5) > 3 THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY c_custkey ORDER BY i)), k AS (SELECT *, (sum(new) OVER (PARTITION BY c_custkey ORDER BY i))::BIGINT AS word_no FROM n)
  SELECT c_custkey, word_no, string_agg(ch, '' ORDER BY i) AS text, min(x)::DOUBLE AS "left", 0.0::DOUBLE AS top, (max(x) + 5)::DOUBLE AS "right", 10.0::DOUBLE AS bottom FROM k GROUP BY c_custkey, word_no""")
def group_characters(spark, sf_dir):
    """Characters of the first lines of stored tables, laid out on a page, grouped back to words."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split("c_name", "")).alias("i", "ch")).filter("ch <> ''")
    laid = c.select("c_custkey", F.col("i").alias("seq"), (F.col("i") * 6 + F.when(F.col("ch") == "#", 9).otherwise(0)).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("width"), F.lit(10.0).alias("height"), "ch")
    return tables.group_characters(laid, "c_custkey")



@query()
def clean_then_score(spark, sf_dir):
    """The older profile: clean the content first, then score what is left."""
    both = X.bind(X.clean_text(F.col("text")), lambda c: F.struct(F.length(c).alias("n"), X.quality_score(c).alias("score")))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", both.alias("b")).select("doc_id", "b.n", "b.score")
