"""Queries of media types, metadata fields, mail headers, entities, classification and error messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import entities
from papyra.plans.registry import query
from papyra.plans.text_queries import WS
from papyra.sources import mime
from papyra.session import spread, table


def _results(spark, sf_dir):
    return table(spark, sf_dir, "extraction_results")


_MIME_CASE = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mime.BY_EXTENSION.items()) + " END"
_LIST = ", ".join(f"'{m}'" for m in mime.SUPPORTED)


@query(f"""SELECT DISTINCT result_id, ext, {_MIME_CASE} AS mime FROM (SELECT result_id, lower(regexp_extract(source_path, '\\.([^./\\\\]+)$', 1)) AS ext FROM extraction_results)""")
def mime_by_extension(spark, sf_dir):
    return _results(spark, sf_dir).select("result_id", mime.extension(F.col("source_path")).alias("ext"), mime.by_extension(F.col("source_path")).alias("mime")).distinct()


@query(f"""SELECT mime_type, content_type, content_type IN ({_LIST}) OR starts_with(content_type, 'image/') AS supported, starts_with(content_type, 'image/') AS image, n
  FROM (SELECT mime_type, lower(trim(split_part(mime_type, ';', 1))) AS content_type, count(DISTINCT result_id) AS n FROM extraction_results WHERE mime_type IS NOT NULL GROUP BY ALL)""")
def mime_validation(spark, sf_dir):
    own = _results(spark, sf_dir).filter("mime_type is not null").groupBy("mime_type").agg(F.countDistinct("result_id").alias("n"))
    c = X.content_type(F.col("mime_type"))
    return own.select("mime_type", c.alias("content_type"), mime.is_supported(c).alias("supported"), X.is_image_mime(c).alias("image"), "n")


_REV = " UNION ALL ".join(f"SELECT '{k}' AS ext, '{v}' AS mime" for k, v in mime.BY_EXTENSION.items())


@query(f"SELECT mime, list_sort(list(DISTINCT ext)) AS extensions FROM ({_REV}) GROUP BY mime")
def mime_extensions(spark, sf_dir):
    return mime.extensions_of(spark)


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(t, '^[{{\\[]') AND json_valid(t) THEN 'application/json' WHEN starts_with(t, '<') THEN 'application/xml'
  WHEN starts_with(t, '%PDF') THEN 'application/pdf' ELSE 'text/plain' END AS kind FROM (SELECT text, regexp_replace(text, '^{WS}+', '') AS t FROM documents)) GROUP BY kind""")
def mime_sniff(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(mime.sniff_text(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_META = "(SELECT DISTINCT result_id, CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata), '{') THEN metadata::JSON END AS m FROM extraction_results)"


def _meta(spark, sf_dir):
    m = F.when(X.valid_json(F.col("metadata")) & F.ltrim("metadata").startswith("{"), F.col("metadata"))
    return _results(spark, sf_dir).select("result_id", m.alias("m")).distinct()


@query(f"""SELECT result_id, CASE WHEN regexp_matches(c, '^(?:D:)?\\d{{8,14}}') THEN substr(p, 1, 4) || '-' || substr(p, 5, 2) || '-' || substr(p, 7, 2) || 'T' || substr(p, 9, 2) || ':' || substr(p, 11, 2) || ':' || substr(p, 13, 2) || 'Z' ELSE c END AS created
  FROM (SELECT result_id, c, rpad(regexp_extract(c, '^(?:D:)?(\\d{{8,14}})', 1), 14, '0') AS p FROM (SELECT result_id, json_extract_string(m, '$.created_at') AS c FROM {_META})) WHERE c IS NOT NULL""")
def metadata_dates(spark, sf_dir):
    rows = _meta(spark, sf_dir).select("result_id", F.get_json_object("m", "$.created_at").alias("c")).filter("c is not null")
    return rows.select("result_id", X.pdf_date(F.col("c")).alias("created"))


@query("""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(s, ' and |[;,]', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS names
  FROM (SELECT doc_id, source || ' and ' || collection || '; ' || coalesce(lang, '') AS s FROM documents WHERE source IS NOT NULL)""")
def split_authors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    s = F.concat("source", F.lit(" and "), "collection", F.lit("; "), F.coalesce("lang", F.lit("")))
    return docs.select("doc_id", X.split_authors(s).alias("names"))


@query(f"""SELECT format_type, count(*) AS n, count(json_extract_string(m, '$.title')) AS titles, count(json_extract_string(m, '$.created_at')) AS dates, count(json_extract_string(m, '$.quality_score')) AS scores
  FROM (SELECT m, json_extract_string(m, '$.format_type') AS format_type FROM {_META} WHERE m IS NOT NULL) GROUP BY format_type""")
def metadata_coverage(spark, sf_dir):
    g = lambda k: F.get_json_object("m", f"$.{k}")
    rows = _meta(spark, sf_dir).filter("m is not null").select(g("format_type").alias("format_type"), g("title").alias("t"), g("created_at").alias("c"), g("quality_score").alias("q"))
    return rows.groupBy("format_type").agg(F.count("*").alias("n"), F.count("t").alias("titles"), F.count("c").alias("dates"), F.count("q").alias("scores"))



_CODES = entities.ERROR_CODES
_CODE_SQL = " ".join(f"WHEN regexp_matches(lower(error_message), '{p}') THEN '{name}'" for name, p in _CODES)


@query(f"SELECT CASE WHEN error_message IS NULL THEN 'none' {_CODE_SQL} ELSE 'unknown' END AS code, count(DISTINCT run_id) AS n FROM benchmark_results GROUP BY 1")
def error_codes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark_results").groupBy(entities.error_code(F.col("error_message")).alias("code")).agg(F.countDistinct("run_id").alias("n"))


def _class_sql() -> str:
    scores = []
    for name, patterns in entities.CLASSES.items():
        hits = " + ".join(f"CASE WHEN contains(t, '{p}') THEN 1 ELSE 0 END" for p in patterns)
        scores.append(f"SELECT doc_id, '{name}' AS document_type, round(({hits})::DOUBLE / {len(patterns)}, 6) AS confidence FROM d")
    rank = "row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, document_type)"
    return f"WITH d AS (SELECT doc_id, lower(concat_ws(' ', text, source, collection, mime_type)) AS t FROM documents WHERE text IS NOT NULL), s AS ({' UNION ALL '.join(scores)}) SELECT doc_id, CASE WHEN confidence >= {entities.THRESHOLD} THEN document_type END AS document_type, confidence FROM (SELECT *, {rank} AS r FROM s) WHERE r = 1"


@query(_class_sql())
def document_type(spark, sf_dir):
    """The class of each document by its text and the values of its metadata."""
    best = entities.classify(entities.with_values(F.col("text"), F.col("source"), F.col("collection"), F.col("mime_type")))
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").filter("text is not null").select("doc_id", best.alias("b"))
    return docs.select("doc_id", F.when(F.col("b.confidence") >= entities.THRESHOLD, F.col("b.document_type")).alias("document_type"), F.round("b.confidence", 6).alias("confidence"))


def _entity_sql() -> str:
    parts = [f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in entities.PATTERNS.items()]
    return f"SELECT doc_id, kind, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query(_entity_sql())
def entity_counts(spark, sf_dir):
    found = entities.matches(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", entities.PATTERNS)
    return found.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


def _spans_sql() -> str:
    # places by what the pieces between matches and the matches before take up
    each = [f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM documents WHERE text IS NOT NULL" for k, p in entities.PATTERNS.items()]
    return f"""WITH e AS ({' UNION ALL '.join(each)}), x AS (SELECT doc_id, kind, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM e), y AS (SELECT doc_id, kind, ms[i] AS value, (coalesce(list_sum(list_transform(ps[:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda m: length(m))), 0))::INTEGER AS char_start FROM x)
  SELECT doc_id, kind, value, char_start, (char_start + length(value))::INTEGER AS char_end FROM y"""


@query(_spans_sql())
def entity_spans(spark, sf_dir):
    return entities.spans(table(spark, sf_dir, "documents"), "doc_id", "text", entities.PATTERNS)


@query("""SELECT category, assert_kind, assert_op, count(*) AS n, count(DISTINCT fixture_id) AS fixtures FROM extraction_fixtures GROUP BY ALL""")
def fixture_summary(spark, sf_dir):
    return table(spark, sf_dir, "extraction_fixtures").groupBy("category", "assert_kind", "assert_op").agg(F.count("*").alias("n"), F.countDistinct("fixture_id").alias("fixtures"))


_FIX = """WITH r AS (SELECT DISTINCT lower(trim(split_part(mime_type, ';', 1))) AS mime, content, CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata), '{') THEN metadata END AS m FROM extraction_results WHERE mime_type IS NOT NULL)
SELECT fixture_id, assert_kind, assert_path, assert_op, assert_value, coalesce(bool_or(CASE assert_kind WHEN 'expected_mime' THEN r.mime IS NOT NULL WHEN 'min_content_length' THEN length(content) >= try_cast(assert_value AS BIGINT) WHEN 'content_contains_any' THEN contains(content, assert_value)
  WHEN 'metadata' THEN CASE assert_op WHEN 'eq' THEN json_extract_string(m, '$.' || assert_path) = assert_value WHEN 'gte' THEN try_cast(json_extract_string(m, '$.' || assert_path) AS DOUBLE) >= try_cast(assert_value AS DOUBLE) END END), false) AS passed
FROM extraction_fixtures f LEFT JOIN r ON r.mime = f.media_type GROUP BY ALL"""


@query(_FIX)
def fixture_check(spark, sf_dir):
    """Every assertion of the fixtures held against the results of its media type: whether one of them meets it.

    The table of fixtures is small and fixed; outcomes are aggregated before they are shuffled.
    """
    ok = F.when(X.valid_json(F.col("metadata")) & F.ltrim("metadata").startswith("{"), F.col("metadata"))
    r = _results(spark, sf_dir).filter("mime_type is not null").select(X.content_type(F.col("mime_type")).alias("media_type"), "content", ok.alias("m"))
    f = table(spark, sf_dir, "extraction_fixtures").select("fixture_id", "media_type", "assert_kind", "assert_path", "assert_op", "assert_value")
    value = F.expr("get_json_object(m, concat('$.', assert_path))")
    meta = F.when(F.col("assert_op") == "eq", value == F.col("assert_value")).when(F.col("assert_op") == "gte", value.try_cast("double") >= F.col("assert_value").try_cast("double"))
    met = (
        F.when(F.col("assert_kind") == "expected_mime", F.lit(True)).when(F.col("assert_kind") == "min_content_length", F.length("content") >= F.col("assert_value").try_cast("bigint"))
        .when(F.col("assert_kind") == "content_contains_any", F.col("content").contains(F.col("assert_value"))).when(F.col("assert_kind") == "metadata", meta)
    )
    keys = ["fixture_id", "assert_kind", "assert_path", "assert_op", "assert_value"]
    found = r.join(f, "media_type").groupBy(*keys).agg(F.bool_or(F.coalesce(met, F.lit(False))).alias("passed"))
    found = found.select(*[F.col(k).alias(f"of_{k}") for k in keys], "passed")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return f.select(*keys).distinct().join(found, same, "left").select(*keys, F.coalesce("passed", F.lit(False)).alias("passed"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS line FROM events WHERE json_valid(props)")
def json_flatten(spark, sf_dir):
    from papyra.sources.extractors import flatten_json

    return table(spark, sf_dir, "events").select("event_id", flatten_json("props").alias("line"))


@query("""SELECT p_partkey, CASE WHEN fits THEN 300 ELSE greatest(72, least(300, least(round(4096 / wi), round(4096 / hi)), floor(sqrt((2048.0 * 1048576 / 3) / (wi * hi)))))::INT END AS dpi FROM (
  SELECT *, greatest(wi * 300, hi * 300) <= 4096 AND wi * 300 * hi * 300 * 3 / 1048576.0 <= 2048 AS fits FROM (SELECT p_partkey, p_size * 40 / 72.0::DOUBLE AS wi, p_size * 55 / 72.0::DOUBLE AS hi FROM part))""")
def optimal_dpi(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.smart_dpi(F.col("p_size") * 40, F.col("p_size") * 55).alias("dpi"))


_CAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.RATIOS.items())


@query(f"SELECT run_id, ceil(file_size * CASE lower(file_extension) {_CAP} ELSE 0.5 END::DOUBLE)::BIGINT AS capacity FROM benchmark_results GROUP BY ALL")
def content_capacity(spark, sf_dir):
    return table(spark, sf_dir, "benchmark_results").select("run_id", X.content_capacity(F.col("file_size"), F.col("file_extension")).alias("capacity")).distinct()


@query("""SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: (x / n)::FLOAT::DOUBLE * (x / n)::FLOAT::DOUBLE))), 4) AS norm, round((embedding[1] / n)::FLOAT::DOUBLE, 5) AS first
  FROM (SELECT *, CASE WHEN s > 0 THEN sqrt(s) ELSE 1 END AS n FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings))""")
def embedding_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", X.l2_normalize(F.col("embedding")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("vec_id", "label", F.round(norm, 4).alias("norm"), F.round(F.col("e")[0].cast("double"), 5).alias("first"))


# Presets of embedding: pieces, overlap, dimensions.
PRESETS = [("fast", 512, 50, 384), ("balanced", 1024, 100, 768), ("quality", 2000, 200, 1024), ("multilingual", 1024, 100, 768)]


@query(" UNION ALL ".join(f"SELECT '{n}' AS preset, {a} AS chunk_size, {b} AS overlap, {d} AS dimensions, (SELECT count(DISTINCT result_id) FROM extraction_results WHERE length(content) > {a}) AS larger" for n, a, b, d in PRESETS))
def embedding_presets(spark, sf_dir):
    presets = spark.createDataFrame(PRESETS, "preset string, chunk_size int, overlap int, dimensions int")
    counts = _results(spark, sf_dir).groupBy().agg(*[F.countDistinct(F.when(F.length("content") > a, F.col("result_id"))).alias(n) for n, a, _, _ in PRESETS])
    larger = counts.select(F.explode(F.create_map(*[x for n, *_ in PRESETS for x in (F.lit(n), F.col(n))])).alias("preset", "larger"))
    return presets.join(larger, "preset")


@query("SELECT doc_id, lang, CASE WHEN lang IS NULL THEN 'missing language' WHEN coalesce(trim(text), '') = '' THEN 'empty text' WHEN n_chars < 20 THEN 'too short' END AS error FROM documents")
def validators(spark, sf_dir):
    from papyra.plans.pipeline import Validator, validate

    checks = [
        Validator("short", 10, lambda d: F.when(F.col("n_chars") < 20, F.lit("too short"))),
        Validator("language", 90, lambda d: F.when(F.col("lang").isNull(), F.lit("missing language"))),
        Validator("empty", 50, lambda d: F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("empty text"))),
    ]
    return validate(table(spark, sf_dir, "documents"), checks).select("doc_id", "lang", "error")


@query()
def pipeline(spark, sf_dir):
    """All stages over all results as a configuration asks for them: quality, keywords, chunks, languages, then validators."""
    from papyra.config import Chunking, Extraction, Keywords, LanguageDetection
    from papyra.plans.pipeline import default_validators, run_configured

    rows = _results(spark, sf_dir).select("result_id", "content", "mime_type").dropDuplicates(["result_id"])
    config = Extraction(chunking=Chunking(), keywords=Keywords("rake"), language_detection=LanguageDetection(min_confidence=0.3))
    out = run_configured(rows, config, checks=default_validators())
    return out.select("result_id", "quality_score", "detected_language", "detected_languages", "chunk_count", "keywords", "error")


def _pipeline_sql() -> str:
    from papyra.functions.stopwords import built_in

    stop = ", ".join(f"'{w}'" for w in built_in("eng"))
    words = f"len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> ''))"
    return rf"""WITH d AS (SELECT result_id, content FROM extraction_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1),
  t AS (SELECT result_id, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\pL\pN'' \-]+', ' ' || chr(1) || ' ', 'g'), '[ \-]+'), lambda w: w <> '') AS ws FROM d),
  p AS (SELECT result_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(ws, lambda w: CASE WHEN w = chr(1) OR w IN ({stop}) THEN chr(1) ELSE w END), ' '), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS phrase FROM t),
  c AS (SELECT result_id, phrase, count(*) AS n, string_split(phrase, ' ') AS words FROM p GROUP BY ALL), w AS (SELECT result_id, phrase, n, len(words) AS size, unnest(words) AS word FROM c),
  v AS (SELECT result_id, word, sum(n * size)::DOUBLE / sum(n) AS w FROM w GROUP BY ALL), r AS (SELECT result_id, phrase, sum(v.w) AS raw, any_value(size) AS size FROM w JOIN v USING (result_id, word) GROUP BY ALL),
  f AS (SELECT *, min(raw) OVER (PARTITION BY result_id) AS lo, max(raw) OVER (PARTITION BY result_id) AS hi FROM r WHERE size <= 3), g AS (SELECT result_id, phrase, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END AS score FROM f),
  k AS (SELECT result_id, list(phrase ORDER BY round(score, 9) DESC, phrase) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY round(score, 9) DESC, phrase) AS k FROM g) WHERE k <= 5 GROUP BY result_id)
  SELECT d.result_id, CASE WHEN {words} >= 10 THEN coalesce(ks, []) END AS keywords, CASE WHEN coalesce(trim(content), '') = '' THEN 'empty text' WHEN mime_ok IS NULL THEN 'no media type' END AS error FROM d LEFT JOIN k USING (result_id)
  JOIN (SELECT result_id, any_value(nullif(mime_type, '')) AS mime_ok FROM extraction_results GROUP BY result_id) m USING (result_id)"""


@query(_pipeline_sql())
def pipeline_keywords(spark, sf_dir):
    """The configured pipeline with RAKE: keywords in texts of ten words or more, and the validators' first error."""
    from papyra.config import Extraction, Keywords
    from papyra.plans.pipeline import Validator, default_validators, run_configured

    rows = _results(spark, sf_dir).select("result_id", "content", "mime_type").dropDuplicates(["result_id"])
    checks = [*default_validators(), Validator("mime", 10, lambda d: F.when(F.coalesce("mime_type", F.lit("")) == "", F.lit("no media type")))]
    out = run_configured(rows, Extraction(enable_quality_processing=False, keywords=Keywords("rake", 5)), checks=checks)
    return out.select("result_id", F.transform("keywords", lambda k: k["keyword"]).alias("keywords"), "error")
