"""Queries that run the readers over made-up files, whose SQL has the texts and tables worked out by hand, and small media types."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from papyra.functions import encoding, planning, stopwords
from papyra.functions import text as X
from papyra.operators import tables
from papyra.plans.registry import query
from papyra.plans.structure_queries import _images, _results
from papyra.plans.text_queries import WS
from papyra.session import spread, table
from papyra.sources import extractors
from papyra.sources.samples import samples


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _expected(group: str) -> str:
    rows = [f"({_quoted(s.name)}, {_quoted(s.text)}, {_quoted(json.dumps([[list(r) for r in t] for t in s.tables], ensure_ascii=False, separators=(',', ':')))}, {_quoted(s.error)})" for s in samples() if s.group == group]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(name, content, tables, error)"


def _read(group: str):
    @query(_expected(group))
    def run(spark, sf_dir):
        """Every made-up file of the group through its reader."""
        files = spark.createDataFrame([(s.name, s.mime, s.data) for s in samples() if s.group == group], "name string, mime_type string, data binary")
        return extractors.extract(files, ["name"]).select("name", "content", F.to_json("tables").alias("tables"), "error")

    return run


def _registered(group: str):
    from papyra.plans.registry import QUERIES, SQL

    run = _read(group)
    QUERIES[f"read_{group}"], SQL[f"read_{group}"] = QUERIES.pop("run"), SQL.pop("run")
    return run


for _group in ("text", "markup", "books", "office", "containers"):
    _registered(_group)


def _extracted(df, data, mime: str, keep: list[str]):
    return extractors.extract(df.select(*keep, data.cast("binary").alias("data"), F.lit(mime).alias("mime_type")), keep)


@query(r"""WITH x AS (SELECT n_nationkey, '<n><name>' || n_name || '</name><r id="1"/>' || repeat('<c/>', n_regionkey) || '</n>' AS t FROM nation), e AS (SELECT n_nationkey, unnest(regexp_extract_all(t, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM x)
  SELECT n_nationkey, count(*) AS element_count, list_sort(list(DISTINCT name)) AS names, any_value(n_name) AS content FROM e JOIN nation USING (n_nationkey) GROUP BY n_nationkey""")
def xml_elements(spark, sf_dir):
    """Elements of XML files by the reader: their number, their names, the text."""
    t = F.concat(F.lit("<n><name>"), F.col("n_name"), F.lit('</name><r id="1"/>'), F.expr("repeat('<c/>', int(n_regionkey))"), F.lit("</n>"))
    out = _extracted(table(spark, sf_dir, "nation"), t, "application/xml", ["n_nationkey"])
    names = F.from_json(F.get_json_object("metadata", "$.unique_elements"), "array<string>")
    return out.select("n_nationkey", F.get_json_object("metadata", "$.element_count").cast("bigint").alias("element_count"), names.alias("names"), "content")


@query("""SELECT n_nationkey, 'Page of ' || n_name AS title, 'Region ' || n_regionkey AS description, '# ' || n_name || chr(10) || chr(10) || '| a | b |' || chr(10) || '| ------ | ------ |' || chr(10) || '| 1 | ' || n_regionkey || ' |' AS content FROM nation""")
def html_metadata(spark, sf_dir):
    """Title, description and table of HTML pages by the reader."""
    h = F.concat(
        F.lit("<html><head><title>Page of "), F.col("n_name"), F.lit('</title><meta name="description" content="'), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")), F.lit('"></head><body><h1>'), F.col("n_name"),
        F.lit("</h1><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table></body></html>"),
    )
    out = _extracted(table(spark, sf_dir, "nation"), h, "text/html", ["n_nationkey"])
    one = lambda k: F.get_json_object("metadata", f"$['{k}']")
    return out.select("n_nationkey", one("title").alias("title"), one("meta-description").alias("description"), "content")


@query("""SELECT DISTINCT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6} +[^\\n]+'))::BIGINT AS headers, len(regexp_extract_all(text, '\\[[^\\]\\n]+\\]\\([^)\\n]+\\)'))::BIGINT AS links,
  len(regexp_extract_all(text, '(?ms)^```\\w*\\n.*?^```'))::BIGINT AS code_blocks FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '---')""")
def markdown_structure(spark, sf_dir):
    """Headings, links and code blocks of documents by the Markdown reader."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").filter("text is not null and not startswith(text, '---')")
    out = _extracted(d, F.col("text"), "text/markdown", ["doc_id"])
    count = lambda k: F.coalesce(F.json_array_length(F.get_json_object("metadata", f"$.{k}")), F.lit(0)).cast("bigint")
    return out.select("doc_id", count("headers").alias("headers"), count("links").alias("links"), count("code_blocks").alias("code_blocks")).distinct()


@query("""SELECT s_suppkey, 'Subject: ' || s_name || chr(10) || 'From: s' || s_suppkey || '@mail.example' || chr(10) || 'To: a@b.example, c@d.example' || chr(10) || 'CC: x@y.example' || chr(10) || chr(10) || 'Nation ' || s_nationkey AS content,
  's' || s_suppkey || '@mail.example' AS from_email FROM supplier""")
def mail_reader(spark, sf_dir):
    """Mails by the reader: header lines, then the body."""
    m = F.concat(F.lit("Subject: "), F.col("s_name"), F.lit("\nFrom: s"), F.col("s_suppkey"), F.lit("@mail.example\nTo: a@b.example, c@d.example\nCc: x@y.example\nContent-Type: text/plain; charset=utf-8\n\nNation "), F.col("s_nationkey"), F.lit("\n"))
    out = _extracted(table(spark, sf_dir, "supplier"), m, "message/rfc822", ["s_suppkey"])
    return out.select("s_suppkey", "content", F.get_json_object("metadata", "$.from_email").alias("from_email"))


@query("SELECT n_nationkey, (n_nationkey * 7 + 1)::BIGINT AS width, (n_regionkey * 300 + 2)::BIGINT AS height, 'PNG' AS format FROM nation")
def image_headers(spark, sf_dir):
    """Size and format of images from their headers."""
    word = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    data = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), word(F.col("n_nationkey") * 7 + 1), word(F.col("n_regionkey") * 300 + 2), F.unhex(F.lit("0802000000")))
    out = _extracted(table(spark, sf_dir, "nation"), data, "image/png", ["n_nationkey"])
    num = lambda k: F.get_json_object("metadata", f"$.{k}").cast("bigint")
    return out.select("n_nationkey", num("width").alias("width"), num("height").alias("height"), F.get_json_object("metadata", "$.format").alias("format"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '\x{FFFD}+', '', 'g'), '[\x{0300}-\x{036F}]+', '', 'g')) AS decoded_md5 FROM documents WHERE NOT starts_with(text, chr(65279))""")
def decode_bytes(spark, sf_dir):
    """Texts from their bytes, without a label."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").filter("not startswith(text, '﻿')")
    return d.select("doc_id", F.md5(encoding.decoded(F.col("text").cast("binary"), F.lit(None).cast("string")).cast("binary")).alias("decoded_md5"))


@query("SELECT c_custkey, c_name || ': Grüße aus Köln' AS decoded FROM customer")
def decode_legacy(spark, sf_dir):
    """Texts in a legacy encoding that nothing names."""
    data = F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit(": Grüße aus Köln".encode("cp1252").hex())))
    return table(spark, sf_dir, "customer").select("c_custkey", encoding.decoded(data, F.lit(None).cast("string")).alias("decoded"))


_UTF = "substr(hex(encode(text)), 2 * p + 1, 1)"


@query(f"SELECT doc_id, p AS place, p = strlen(text) OR {_UTF} NOT IN ('8', '9', 'A', 'B') AS valid FROM (SELECT doc_id, text, unnest(range(0, strlen(text) + 1, 97)) AS p FROM documents WHERE text IS NOT NULL)")
def utf8_boundaries(spark, sf_dir):
    """Which places in the bytes of a text lie between characters."""
    from papyra.operators.chunking import utf8_boundary

    d = spread(table(spark, sf_dir, "documents"), "doc_id").filter("text is not null")
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.octet_length("text").cast("bigint"), F.lit(97).cast("bigint")))
    return d.select("doc_id", "text", places.alias("place")).select("doc_id", "place", utf8_boundary(F.col("text"), F.col("place")).alias("valid"))


_I = "(SELECT result_id, p.page_number AS page, unnest(p.images) AS i FROM (SELECT result_id, unnest(pages) AS p FROM (SELECT * FROM extraction_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1)) WHERE p IS NOT NULL)"


@query(f"""WITH x AS (SELECT result_id, page, i.image_index AS image_index, i.width AS w, i.height AS h FROM {_I} WHERE i IS NOT NULL AND i.width IS NOT NULL AND i.height IS NOT NULL), r AS (SELECT *, CASE WHEN h > 0 THEN w::DOUBLE / h ELSE 1.0 END AS ratio, w::DOUBLE * h / 1e6 AS mega FROM x)
  SELECT result_id, page, image_index, CASE WHEN mega > 50 THEN 240.0 ELSE 300.0 END::DOUBLE AS recommended_dpi, CASE WHEN mega > 50 OR w::DOUBLE * h * 3 / 1048576 > 200 OR 300 / 96.0 > 1.5 THEN 'high' ELSE 'medium' END AS performance_impact, ratio < 0.8 AS is_portrait, ratio > 1.2 AS is_landscape,
  greatest(w, h) > 4096 * 0.8 AS is_large, round(2.5 * mega * CASE WHEN mega > 10 THEN 1.0 + (mega - 10) * 0.1 ELSE 1.0 END, 6) AS seconds FROM r""")
def dpi_advice(spark, sf_dir):
    """DPI advice and OCR time of images."""
    i = F.col("i")
    rows = _images(spark, sf_dir).filter(i["width"].isNotNull() & i["height"].isNotNull())
    a = planning.dpi_advice(i["width"], i["height"], 96, 300, 4096)
    out = rows.select("result_id", "page", i["image_index"].alias("image_index"), a.alias("a"), F.round(planning.ocr_seconds(i["width"], i["height"]), 6).alias("seconds"))
    return out.select("result_id", "page", "image_index", "a.recommended_dpi", "a.performance_impact", "a.is_portrait", "a.is_landscape", "a.is_large", "seconds")


_RATIO = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in planning.POOLS.items())
_POOL = " ".join(f"WHEN '{k}' THEN {v[1] * v[2]}" for k, v in planning.POOLS.items())


@query(f"""SELECT mime, ratio::DOUBLE AS ratio, pool::BIGINT AS pool FROM (SELECT DISTINCT mime_type AS mime, CASE lower(trim(split_part(mime_type, ';', 1))) {_RATIO} ELSE 0.5 END AS ratio, CASE lower(trim(split_part(mime_type, ';', 1))) {_POOL} ELSE 24576 END AS pool FROM extraction_results)""")
def pool_sizes(spark, sf_dir):
    """Planned text share and pool of each media type."""
    m = F.col("mime_type")
    return table(spark, sf_dir, "extraction_results").select("mime_type").distinct().select(m.alias("mime"), planning.pool_ratio(m).alias("ratio"), planning.pool_size(m).cast("bigint").alias("pool"))


_CUSTOM = {"eng": ["Whereas", "hereby"], "deu": ["sowie"]}
_EXTRA = ", ".join(f"('{k}', '{w.lower()}')" for k, ws in _CUSTOM.items() for w in ws)
_KEPT = ", ".join(f"'{w}'" for w in stopwords.KEPT)


@query(f"SELECT lang, list_sort(list(DISTINCT word)) AS words FROM (SELECT lang, lower(word) AS word FROM stopwords UNION ALL SELECT * FROM (VALUES {_EXTRA}) v(lang, word)) WHERE word NOT IN ({_KEPT}) GROUP BY lang")
def stopword_lists(spark, sf_dir):
    """Stop words of each language with custom words and without the kept ones."""
    return stopwords.lists(table(spark, sf_dir, "stopwords"), _CUSTOM).select("lang", F.col("stop").alias("words"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(trim(lang)), '^[^-_]+[-_]') THEN regexp_extract(lower(trim(lang)), '^([^-_]+)[-_]', 1) ELSE substr(lower(trim(lang)), 1, 2) END AS code FROM (SELECT doc_id, lang || '-XX' AS lang FROM documents UNION ALL SELECT -doc_id, lang FROM documents) WHERE lang IS NOT NULL""")
def stopword_codes(spark, sf_dir):
    """Language codes without region and case."""
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    both = d.select("doc_id", F.concat("lang", F.lit("-XX")).alias("lang")).unionByName(d.select((-F.col("doc_id")).alias("doc_id"), "lang"))
    return both.select("doc_id", stopwords.normalized(F.col("lang")).alias("code"))


_ROW = "'| ' || array_to_string(list_transform(list_resize(coalesce(r, []), len(t.cells[1]), ''), lambda c: replace(coalesce(c, ''), '|', '\\|')), ' | ') || ' |'"
_MD = f"CASE WHEN t.cells IS NULL OR len(t.cells) = 0 OR t.cells[1] IS NULL OR len(t.cells[1]) = 0 THEN '' ELSE array_to_string(list_concat([list_transform(t.cells, lambda r: {_ROW})[1], '|' || repeat(' ------ |', len(t.cells[1]))], list_transform(t.cells, lambda r: {_ROW})[2:]), chr(10)) END"
_TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query(f"""WITH r AS (SELECT result_id, content, metadata, list_transform(coalesce(list_filter(tables, lambda t: t IS NOT NULL), []), lambda t: {_TRIM(_MD)}) AS ts FROM extraction_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1)
  SELECT result_id, md5(concat_ws(chr(10) || chr(10), nullif({_TRIM("coalesce(content, '')")}, ''), CASE WHEN len(ts) > 0 THEN '## Tables' || chr(10) || chr(10) || array_to_string(list_transform(ts, lambda t, i: '### Table ' || i || chr(10) || chr(10) || CASE WHEN t = '' THEN '_No table data available._' ELSE t END), chr(10) || chr(10)) END,
  CASE WHEN metadata <> '' THEN '## Metadata' || chr(10) || chr(10) || '```json' || chr(10) || metadata || chr(10) || '```' END)) AS rendered_md5 FROM r""")
def render_markdown(spark, sf_dir):
    """Results as Markdown documents: content, tables under headings, metadata as JSON."""
    r = _results(spark, sf_dir)
    md = F.transform(F.filter("tables", lambda t: t.isNotNull()), lambda t: tables.markdown(t["cells"]))
    return r.select("result_id", F.md5(tables.rendered(F.col("content"), md, F.col("metadata")).cast("binary")).alias("rendered_md5"))


_KNOWN = ", ".join(f"'{k}'" for k in ("title", "subject", "authors", "keywords", "language", "created_at", "modified_at", "pages", "format_type", "error"))


@query(f"""WITH m AS (SELECT DISTINCT result_id, metadata FROM extraction_results WHERE json_valid(metadata) AND starts_with(ltrim(metadata), '{{')), k AS (SELECT result_id, json_keys(metadata::JSON) AS ks FROM m)
  SELECT result_id, list_sort(list_filter(ks, lambda x: x IN ({_KNOWN}))) AS fields, list_sort(list_filter(ks, lambda x: x NOT IN ({_KNOWN}))) AS attributes FROM k""")
def metadata_normalize(spark, sf_dir):
    """Metadata parted into known fields and attributes, by name."""
    r = table(spark, sf_dir, "extraction_results").filter(X.valid_json(F.col("metadata")) & F.ltrim("metadata").startswith("{")).select("result_id", "metadata").distinct()
    known, other = X.known_fields(F.col("metadata"))
    return r.select("result_id", F.array_sort(known).alias("fields"), F.array_sort(other).alias("attributes"))


@query("""WITH s AS (SELECT lower(trim(framework)) AS framework, count(*) AS n, sum(file_size) AS total, max(file_size / greatest(1, file_size // 150)) AS ratio, max(file_size) AS largest FROM (SELECT DISTINCT run_id, framework, file_size FROM benchmark_results WHERE file_size IS NOT NULL) GROUP BY 1)
  SELECT framework, n, CASE WHEN n > 10000 THEN 'the archive has too many members' WHEN total > 524288000 THEN 'the content is larger than the limit allows' WHEN ratio > 100 AND largest > 1048576 THEN 'the archive''s compression ratio is above the limit' END AS error FROM s""")
def resource_guard(spark, sf_dir):
    """What the guard of archives says of each framework's files, were they the members of one archive."""
    r = table(spark, sf_dir, "benchmark_results").filter("file_size is not null").select("run_id", F.lower(F.trim("framework")).alias("framework"), "file_size").distinct()
    packed = F.greatest(F.lit(1), F.floor(F.col("file_size") / 150))
    s = r.groupBy("framework").agg(F.count("*").alias("n"), F.sum("file_size").alias("total"), F.max(F.col("file_size") / packed).alias("ratio"), F.max("file_size").alias("largest"))
    return s.select("framework", "n", extractors.guard_error(F.col("n"), F.col("total"), F.col("ratio"), F.col("largest")).alias("error"))
