"""Queries of chunks, pages, tables, images, keywords and languages."""

from __future__ import annotations

from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from papyra.config import Keywords
from papyra.functions import text as X
from papyra.functions.stopwords import built_in
from papyra.operators import chunking, keywords, language, tables
from papyra.plans.registry import SQL, query
from papyra.plans.text_queries import ISO, _ISO_SQL
from papyra.session import spread, table


def _results(spark, sf_dir):
    return table(spark, sf_dir, "extraction_results").dropDuplicates(["result_id"])


_ONE = "(SELECT * FROM extraction_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1)"

# ---------------------------------------------------------------- chunks and pages


@query("""WITH c AS (SELECT chunk_id, result_id, chunk_index, any_value(content) AS content FROM chunks WHERE content IS NOT NULL AND result_id IS NOT NULL GROUP BY ALL),
  s AS (SELECT *, strlen(content) AS size FROM c) SELECT chunk_id, result_id, chunk_index, coalesce(sum(size - least(200, size)) OVER (PARTITION BY result_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start,
  (coalesce(sum(size - least(200, size)) OVER (PARTITION BY result_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size)::BIGINT AS byte_end, count(*) OVER (PARTITION BY result_id) AS total_chunks FROM s""")
def chunk_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").filter("content is not null and result_id is not null").groupBy("chunk_id", "result_id", "chunk_index").agg(F.first("content").alias("content"))
    by = Win.partitionBy("result_id").orderBy("chunk_index", "chunk_id")
    size = F.octet_length("content").cast("bigint")
    before = F.coalesce(F.sum(size - F.least(F.lit(200), size)).over(by.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    return c.select("chunk_id", "result_id", "chunk_index", before.alias("byte_start"), (before + size).alias("byte_end"), F.count("*").over(Win.partitionBy("result_id")).alias("total_chunks"))


_BOUND = "json_transform(CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata), '{') THEN metadata END, '{\"pages\": {\"boundaries\": [{\"byte_start\": \"BIGINT\", \"byte_end\": \"BIGINT\", \"page_number\": \"INTEGER\"}]}}').pages.boundaries"


@query(f"""WITH r AS (SELECT result_id, list_filter({_BOUND}, lambda b: b IS NOT NULL AND b.byte_start IS NOT NULL) AS bs, chunks FROM {_ONE}), c AS (SELECT result_id, bs, unnest(list_filter(chunks, lambda c: c IS NOT NULL AND c.metadata IS NOT NULL)) AS c FROM r),
  h AS (SELECT result_id, c.metadata.chunk_index AS chunk_index, c.metadata.byte_start AS s, c.metadata.byte_end AS e, list_filter(bs, lambda b: c.metadata.byte_start < b.byte_end AND c.metadata.byte_end > b.byte_start) AS hit FROM c)
  SELECT result_id, chunk_index, s AS byte_start, e AS byte_end, hit[1].page_number AS first_page, hit[-1].page_number AS last_page FROM h""")
def chunk_page_range(spark, sf_dir):
    # numbers may be stored as texts: read texts, then cast
    schema = "struct<pages:struct<boundaries:array<struct<byte_start:string,byte_end:string,page_number:string>>>>"
    ok = F.when(X.valid_json(F.col("metadata")) & F.ltrim("metadata").startswith("{"), F.col("metadata"))
    read = F.transform(F.from_json(ok, schema)["pages"]["boundaries"], lambda b: F.named_struct(F.lit("byte_start"), b["byte_start"].try_cast("bigint"), F.lit("byte_end"), b["byte_end"].try_cast("bigint"), F.lit("page_number"), b["page_number"].try_cast("int")))
    bs = F.filter(read, lambda b: b["byte_start"].isNotNull())
    c = _results(spark, sf_dir).select("result_id", bs.alias("bs"), F.explode(F.filter("chunks", lambda c: c.isNotNull() & c["metadata"].isNotNull())).alias("c"))
    m = F.col("c.metadata")
    pages = chunking.page_range(m["byte_start"], m["byte_end"], F.col("bs"))
    return c.select("result_id", m["chunk_index"].alias("chunk_index"), m["byte_start"].alias("byte_start"), m["byte_end"].alias("byte_end"), pages["first_page"].alias("first_page"), pages["last_page"].alias("last_page"))


@query()
def chunk_markdown(spark, sf_dir):
    """Pieces at headings, rules and blocks of Markdown."""
    rows = chunking.chunk(_results(spark, sf_dir).filter("content is not null"), "result_id", "content", 800, 100, "markdown")
    return rows.select("result_id", "chunk_index", F.length("content").alias("n_chars"))


@query()
def chunk_text(spark, sf_dir):
    rows = chunking.chunk(_results(spark, sf_dir).filter("content is not null"), "result_id", "content")
    return chunking.with_offsets(rows, "result_id", 200).select("result_id", "chunk_index", F.length("content").alias("n_chars"), "byte_start", "byte_end", "total_chunks")


@query(f"""SELECT result_id, len(pages) AS n_pages, len(list_filter(pages, lambda p: p IS NOT NULL)) AS n_real, coalesce(list_sum(list_transform(list_filter(pages, lambda p: p IS NOT NULL), lambda p: strlen(p.content))), 0)::BIGINT AS bytes,
  coalesce(list_sum(list_transform(list_filter(pages, lambda p: p IS NOT NULL), lambda p: len(p.images))), 0)::BIGINT AS n_images FROM {_ONE} WHERE pages IS NOT NULL""")
def page_structure(spark, sf_dir):
    real = F.filter("pages", lambda p: p.isNotNull())
    total = lambda f: F.aggregate(F.transform(real, f), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    rows = _results(spark, sf_dir).filter("pages is not null")
    return rows.select("result_id", F.size("pages").cast("bigint").alias("n_pages"), F.size(real).cast("bigint").alias("n_real"), total(lambda p: F.octet_length(p["content"]).cast("bigint")).alias("bytes"), total(lambda p: F.when(p["images"].isNotNull(), F.size(p["images"])).cast("bigint")).alias("n_images"))


@query(f"""WITH p AS (SELECT result_id, unnest(pages) AS p FROM {_ONE}), q AS (SELECT result_id, p.page_number AS page_number, strlen(p.content) AS size, row_number() OVER (PARTITION BY result_id ORDER BY p.page_number, p.content) AS spot FROM p WHERE p IS NOT NULL AND p.content IS NOT NULL)
  SELECT result_id, page_number, (sum(size + 2) OVER (PARTITION BY result_id ORDER BY spot) - size - 2)::BIGINT AS byte_start, (sum(size + 2) OVER (PARTITION BY result_id ORDER BY spot) - 2)::BIGINT AS byte_end FROM q""")
def page_boundaries(spark, sf_dir):
    p = _results(spark, sf_dir).select("result_id", F.explode("pages").alias("p")).filter("p is not null and p.content is not null")
    by = Win.partitionBy("result_id").orderBy("p.page_number", "p.content").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    size = F.octet_length("p.content").cast("bigint")
    end = F.sum(size + 2).over(by)
    return p.select("result_id", F.col("p.page_number").alias("page_number"), (end - size - 2).alias("byte_start"), (end - 2).alias("byte_end"))


@query(f"""WITH p AS (SELECT DISTINCT result_id, p.page_number AS page_number FROM (SELECT result_id, unnest(pages) AS p FROM {_ONE}) WHERE p IS NOT NULL), t AS (SELECT result_id, t.page_number AS page_number, count(*) AS n FROM (SELECT result_id, unnest(tables) AS t FROM {_ONE}) WHERE t IS NOT NULL GROUP BY ALL)
  SELECT p.result_id, p.page_number, coalesce(t.n, 0) AS n_tables FROM p LEFT JOIN t USING (result_id, page_number)""")
def page_tables(spark, sf_dir):
    """Tables hung on the pages they name; tables of no page are left out."""
    r = _results(spark, sf_dir)
    p = r.select("result_id", F.explode("pages").alias("p")).filter("p is not null").select("result_id", F.col("p.page_number").alias("page_number")).distinct()
    t = r.select("result_id", F.explode("tables").alias("t")).filter("t is not null").groupBy("result_id", F.col("t.page_number").alias("page_number")).agg(F.count("*").alias("n"))
    return p.join(t, ["result_id", "page_number"], "left").select("result_id", "page_number", F.coalesce("n", F.lit(0)).alias("n_tables"))


# ---------------------------------------------------------------- tables

_T = f"(SELECT result_id, i AS table_no, tables[i + 1].cells AS cells, tables[i + 1].page_number AS page_number FROM (SELECT result_id, tables, unnest(range(len(tables))) AS i FROM {_ONE}) WHERE tables[i + 1] IS NOT NULL)"


def _tables(spark, sf_dir):
    t = _results(spark, sf_dir).select("result_id", F.posexplode("tables").alias("table_no", "t")).filter("t is not null")
    return t.select("result_id", "table_no", F.col("t.cells").alias("cells"), F.col("t.page_number").alias("page_number"))


_ROW = "'| ' || array_to_string(list_transform(list_resize(coalesce(r, []), len(cells[1]), ''), lambda c: replace(coalesce(c, ''), '|', '\\|')), ' | ') || ' |'"


@query(f"""SELECT result_id, table_no, md5(CASE WHEN cells IS NULL OR len(cells) = 0 OR len(cells[1]) = 0 OR cells[1] IS NULL THEN '' ELSE array_to_string(list_concat([list_transform(cells, lambda r: {_ROW})[1], '|' || repeat(' ------ |', len(cells[1]))], list_transform(cells, lambda r: {_ROW})[2:]), chr(10)) END) AS markdown_md5
  FROM {_T}""")
def table_markdown(spark, sf_dir):
    return _tables(spark, sf_dir).select("result_id", F.col("table_no").cast("bigint").alias("table_no"), F.md5(tables.markdown(F.col("cells")).cast("binary")).alias("markdown_md5"))


@query(f"""WITH t AS (SELECT result_id, page_number, len(cells) AS n_rows, len(cells[1]) AS n_cols FROM {_T}) SELECT result_id, count(*) AS n_tables, sum(n_rows)::BIGINT AS total_rows, round(avg(n_rows), 6) AS mean_rows, round(avg(n_cols), 6) AS mean_cols, count(DISTINCT page_number) AS n_pages FROM t GROUP BY result_id""")
def table_summary(spark, sf_dir):
    t = _tables(spark, sf_dir).select("result_id", "page_number", F.when(F.col("cells").isNotNull(), F.size("cells")).alias("r"), F.when(F.col("cells")[0].isNotNull(), F.size(F.col("cells")[0])).alias("c"))
    return t.groupBy("result_id").agg(F.count("*").alias("n_tables"), F.sum("r").alias("total_rows"), F.round(F.avg("r"), 6).alias("mean_rows"), F.round(F.avg("c"), 6).alias("mean_cols"), F.countDistinct("page_number").alias("n_pages"))


_BLANK = "coalesce(trim(c), '') = ''"
_NUMERIC = f"""len(list_filter(range(1, greatest(len(cells[1]), 1) + 1), lambda i: len(list_filter(list_transform(cells[2:], lambda r: r[i]), lambda c: NOT ({_BLANK}))) > 0
  AND len(list_filter(list_transform(cells[2:], lambda r: r[i]), lambda c: NOT ({_BLANK}) AND NOT regexp_matches(c, '^-?[0-9]+(\\.[0-9]+)?$'))) = 0))"""


@query(f"""SELECT result_id, table_no, greatest(len(cells) - 1, 0)::BIGINT AS n_rows, len(cells[1])::BIGINT AS n_cols, len(list_filter(flatten(cells), lambda c: {_BLANK}))::BIGINT AS n_empty, {_NUMERIC}::BIGINT AS n_numeric,
  CASE WHEN len(flatten(cells)) > 0 THEN round(1 - len(list_filter(flatten(cells), lambda c: {_BLANK}))::DOUBLE / len(flatten(cells)), 6) ELSE 0.0 END AS density FROM {_T} WHERE cells IS NOT NULL AND len(cells) > 0""")
def table_structure(spark, sf_dir):
    t = _tables(spark, sf_dir).filter("cells is not null and size(cells) > 0")
    return t.select("result_id", "table_no", *[v.alias(k) for k, v in tables.structure(F.col("cells")).items()])


_FULL = f"list_filter(cells, lambda r: len(list_filter(r, lambda c: NOT ({_BLANK}))) > 0)"


@query(f"""WITH f AS (SELECT result_id, table_no, {_FULL} AS rs FROM {_T} WHERE cells IS NOT NULL), w AS (SELECT *, greatest(coalesce(list_max(list_transform(rs, lambda r: len(r))), 0), 1) AS n FROM f),
  k AS (SELECT *, list_filter(range(1, n + 1), lambda i: len(list_filter(rs, lambda r: coalesce(trim(r[i]), '') <> '')) > 0) AS keep FROM w)
  SELECT result_id, table_no, array_to_string(list_transform(rs, lambda r: array_to_string(list_transform(list_transform(keep, lambda i: coalesce(r[i], '')), lambda c: CASE WHEN regexp_matches(c, '[",\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',')), chr(10)) AS csv FROM k""")
def table_csv(spark, sf_dir):
    t = _tables(spark, sf_dir).filter("cells is not null")
    return t.select("result_id", "table_no", F.array_join(F.transform(tables.drop_empty(F.col("cells")), lambda r: tables.csv_line(r)), "\n").alias("csv"))


def _placed(spark, sf_dir):
    """Words of stored tables at the places that their cells would have on a page."""
    t = _tables(spark, sf_dir).filter("cells is not null").select(F.concat_ws("-", "result_id", "table_no").alias("page"), F.posexplode("cells").alias("r", "row"))
    w = t.select("page", "r", F.posexplode("row").alias("c", "text")).filter("trim(text) <> ''")
    return w.select("page", "text", (F.col("c") * 120 + F.lit(10)).cast("double").alias("left"), (F.col("r") * 30 + F.col("c") % 3).cast("double").alias("top"), F.lit(12.0).alias("height"))


# the places are so made that every row and column with a filled cell is found again
_PLACED = f"""WITH w AS (SELECT result_id || '-' || table_no AS page, r, c, cells[r][c] AS text FROM (SELECT *, unnest(range(1, len(cells[r]) + 1)) AS c FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS r FROM {_T} WHERE cells IS NOT NULL) WHERE cells[r] IS NOT NULL) WHERE trim(cells[r][c]) <> ''),
  rs AS (SELECT page, r, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS row_no FROM (SELECT DISTINCT page, r FROM w)), cs AS (SELECT DISTINCT page, c FROM w), g AS (SELECT rs.page, rs.row_no, rs.r, cs.c FROM rs JOIN cs USING (page)),
  f AS (SELECT g.page, g.row_no::INTEGER AS row_no, list(coalesce(w.text, '') ORDER BY g.c) AS cells FROM g LEFT JOIN w ON w.page = g.page AND w.r = g.r AND w.c = g.c GROUP BY ALL)"""


@query(_PLACED + " SELECT page, row_no, cells FROM f")
def table_reconstruct(spark, sf_dir):
    """Grids of stored tables rebuilt from the places of their words."""
    return tables.reconstruct(_placed(spark, sf_dir), "page")


_FOUND = r"'| ' || array_to_string(list_transform(cells, lambda c: replace(c, '|', '\|')), ' | ') || ' |'"


@query(_PLACED + f""", l AS (SELECT page, row_no, {_FOUND} || CASE WHEN row_no = 0 THEN chr(10) || '|' || repeat(' ------ |', len(cells)) ELSE '' END AS line FROM f) SELECT page, string_agg(line, chr(10) ORDER BY row_no) AS markdown FROM l GROUP BY page""")
def table_reconstruct_markdown(spark, sf_dir):
    """The rebuilt grids as pipe tables."""
    return tables.reconstructed_markdown(_placed(spark, sf_dir), "page")


# ---------------------------------------------------------------- images

_I = f"(SELECT result_id, p.page_number AS page, unnest(p.images) AS i FROM (SELECT result_id, unnest(pages) AS p FROM {_ONE}) WHERE p IS NOT NULL)"


def _images(spark, sf_dir):
    p = _results(spark, sf_dir).select("result_id", F.explode("pages").alias("p")).filter("p is not null")
    return p.select("result_id", F.col("p.page_number").alias("page"), F.explode("p.images").alias("i")).filter("i is not null")


@query(f"""SELECT result_id, page, image_index, skip_reason FROM (SELECT result_id, page, i.image_index AS image_index, CASE WHEN i.format IS NULL OR i.format NOT IN ('jpeg', 'jpg', 'png', 'tiff', 'webp', 'bmp') THEN 'format' WHEN i.width < 50 OR i.height < 50 THEN 'too small' WHEN i.width > 10000 OR i.height > 10000 THEN 'too large' END AS skip_reason FROM {_I} WHERE i IS NOT NULL)""")
def image_eligibility(spark, sf_dir):
    i = F.col("i")
    reason = F.when(i["format"].isNull() | ~i["format"].isin("jpeg", "jpg", "png", "tiff", "webp", "bmp"), "format").when((i["width"] < 50) | (i["height"] < 50), "too small").when((i["width"] > 10000) | (i["height"] > 10000), "too large")
    return _images(spark, sf_dir).select("result_id", "page", i["image_index"].alias("image_index"), reason.alias("skip_reason"))


@query(f"""WITH s AS (SELECT result_id, page, i.image_index AS image_index, i.width::BIGINT * i.height AS size FROM {_I} WHERE i IS NOT NULL AND i.width IS NOT NULL AND i.height IS NOT NULL),
  k AS (SELECT *, sum(size) OVER (PARTITION BY result_id ORDER BY size, page, image_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s WHERE size <= 5000000) SELECT result_id, page, image_index, size FROM k WHERE run <= 12000000""")
def image_limits(spark, sf_dir):
    """Images over a single limit go; of the rest the smallest stay until the total limit."""
    i = F.col("i")
    s = _images(spark, sf_dir).select("result_id", "page", i["image_index"].alias("image_index"), (i["width"].cast("bigint") * i["height"]).alias("size")).filter("size <= 5000000")
    run = F.sum("size").over(Win.partitionBy("result_id").orderBy("size", "page", "image_index").rowsBetween(Win.unboundedPreceding, Win.currentRow))
    return s.withColumn("run", run).filter("run <= 12000000").drop("run")


_SAME = "concat_ws(chr(1), i.format, i.width, i.height, i.is_mask, i.description, i.ocr_result.content)"


@query(f"""SELECT result_id, page, image_index FROM (SELECT result_id, page, i.image_index AS image_index, row_number() OVER (PARTITION BY result_id, CASE WHEN i.description IS NULL AND i.ocr_result.content IS NULL THEN 'own ' || page || ' ' || i.image_index ELSE {_SAME} END ORDER BY page, i.image_index) AS r FROM {_I} WHERE i IS NOT NULL) WHERE r = 1""")
def image_dedup(spark, sf_dir):
    """The first of equal images. The table has no bytes, so images are equal where all that is known of their content is; one of which nothing is known equals none."""
    i = F.col("i")
    known = F.concat_ws("\x01", i["format"], i["width"].cast("string"), i["height"].cast("string"), i["is_mask"].cast("string"), i["description"], i["ocr_result"]["content"])
    alone = F.concat(F.lit("own "), F.col("page").cast("string"), F.lit(" "), i["image_index"].cast("string"))
    key = F.when(i["description"].isNull() & i["ocr_result"]["content"].isNull(), alone).otherwise(known)
    rows = _images(spark, sf_dir).select("result_id", "page", i["image_index"].alias("image_index"), key.alias("k"))
    return rows.withColumn("r", F.row_number().over(Win.partitionBy("result_id", "k").orderBy("page", "image_index"))).filter("r = 1").select("result_id", "page", "image_index")


# ---------------------------------------------------------------- keywords and languages


def _with_stop(spark, sf_dir):
    stop = table(spark, sf_dir, "stopwords").groupBy("lang").agg(F.collect_set("word").alias("stop"))
    codes = F.create_map(*[F.lit(x) for kv in ISO.items() for x in kv])
    d = spread(table(spark, sf_dir, "documents"), "doc_id").filter("text is not null").select("doc_id", "text", F.coalesce(F.try_element_at(codes, F.lower("lang")), F.lit("eng")).alias("l3"))
    return d.join(stop, d.l3 == stop.lang)


_RAKE = rf"""WITH s AS (SELECT lang, list(DISTINCT word) AS stop FROM stopwords GROUP BY lang), d AS (SELECT doc_id, text, CASE lower(lang) {_ISO_SQL} ELSE 'eng' END AS l3 FROM documents WHERE text IS NOT NULL),
  t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\pL\pN'' \-]+', ' ' || chr(1) || ' ', 'g'), '[ \-]+'), lambda w: w <> '') AS ws, stop FROM d JOIN s ON s.lang = d.l3),
  p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(ws, lambda w: CASE WHEN w = chr(1) OR list_contains(stop, w) THEN chr(1) ELSE w END), ' '), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS phrase FROM t),
  c AS (SELECT doc_id, phrase, count(*) AS n, string_split(phrase, ' ') AS words FROM p GROUP BY ALL), w AS (SELECT doc_id, phrase, n, len(words) AS size, unnest(words) AS word FROM c),
  v AS (SELECT doc_id, word, sum(n * size)::DOUBLE / sum(n) AS w FROM w GROUP BY ALL), r AS (SELECT doc_id, phrase, sum(v.w) AS raw, any_value(size) AS size FROM w JOIN v USING (doc_id, word) GROUP BY ALL),
  f AS (SELECT *, min(raw) OVER (PARTITION BY doc_id) AS lo, max(raw) OVER (PARTITION BY doc_id) AS hi FROM r WHERE size <= 3), g AS (SELECT doc_id, phrase, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END AS score FROM f)
  SELECT doc_id, phrase AS keyword, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS k FROM g) WHERE k <= 10"""


@query(_RAKE)
def rake_keywords(spark, sf_dir):
    return keywords.rake(_with_stop(spark, sf_dir), "doc_id", "text", "stop").select("doc_id", "keyword", F.round("score", 6).alias("score"))


def _rake_by(tag: str, stopped: str) -> str:
    """RAKE of two or three words with a least score of 0.2, five at most; `stopped` tells a stop word w."""
    return rf"""t{tag} AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\pL\pN'' \-]+', ' ' || chr(1) || ' ', 'g'), '[ \-]+'), lambda w: w <> '') AS ws, stop FROM d JOIN s ON s.lang = d.l3),
  p{tag} AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(ws, lambda w: CASE WHEN w = chr(1) OR {stopped} THEN chr(1) ELSE w END), ' '), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS phrase FROM t{tag}),
  c{tag} AS (SELECT doc_id, phrase, count(*) AS n, string_split(phrase, ' ') AS words FROM p{tag} GROUP BY ALL), w{tag} AS (SELECT doc_id, phrase, n, len(words) AS size, unnest(words) AS word FROM c{tag}),
  v{tag} AS (SELECT doc_id, word, sum(n * size)::DOUBLE / sum(n) AS w FROM w{tag} GROUP BY ALL), r{tag} AS (SELECT doc_id, phrase, sum(v{tag}.w) AS raw, any_value(size) AS size FROM w{tag} JOIN v{tag} USING (doc_id, word) GROUP BY ALL),
  f{tag} AS (SELECT *, min(raw) OVER (PARTITION BY doc_id) AS lo, max(raw) OVER (PARTITION BY doc_id) AS hi FROM r{tag} WHERE size BETWEEN 2 AND 3), g{tag} AS (SELECT doc_id, phrase, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END AS score FROM f{tag}),
  k{tag} AS (SELECT doc_id, phrase AS keyword, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS k FROM g{tag} WHERE score >= 0.2) WHERE k <= 5)"""


def _rake_configured_sql() -> str:
    english = ", ".join(f"'{w}'" for w in built_in("eng"))
    head = f"WITH s AS (SELECT lang, list(DISTINCT word) AS stop FROM stopwords GROUP BY lang), d AS (SELECT doc_id, text, CASE lower(lang) {_ISO_SQL} ELSE 'eng' END AS l3 FROM documents WHERE text IS NOT NULL)"
    return f"{head}, {_rake_by('a', 'list_contains(stop, w)')}, {_rake_by('b', f'w IN ({english})')} SELECT * FROM ka UNION ALL SELECT * FROM kb WHERE doc_id NOT IN (SELECT doc_id FROM ka)"


@query(_rake_configured_sql())
def rake_configured(spark, sf_dir):
    """RAKE by settings: two or three words, a least score, English stop words where a document's own give nothing."""
    found = keywords.extract(_with_stop(spark, sf_dir), "doc_id", "text", "stop", Keywords("rake", 5, 0.2, (2, 3)), built_in("eng"))
    return found.select("doc_id", "keyword", F.round("score", 6).alias("score"))


@query()
def yake_keywords(spark, sf_dir):
    return keywords.yake(_with_stop(spark, sf_dir), "doc_id", "text", "stop")


@query(r"""WITH t AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM documents) GROUP BY ALL), v AS (SELECT doc_id, lang, sum(n) AS n FROM t JOIN (SELECT DISTINCT lang, word FROM stopwords) USING (word) GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS k FROM v) SELECT doc_id, lang, round(n::DOUBLE / total, 6) AS confidence FROM r WHERE k = 1""")
def language_detect(spark, sf_dir):
    found = language.detect(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", table(spark, sf_dir, "stopwords"))
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


@query(r"""WITH s AS (SELECT doc_id, i, substr(text, (i * 200 + 1)::INT, 200) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 200 + 1)) AS i FROM documents WHERE length(text) > 0)),
  t AS (SELECT doc_id, i, word, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(part), '\pL+')) AS word FROM s) GROUP BY ALL), v AS (SELECT doc_id, i, lang, sum(n) AS n FROM t JOIN (SELECT DISTINCT lang, word FROM stopwords) USING (word) GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, i) AS total, row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC, lang) AS k FROM v) SELECT doc_id, lang, count(*) AS n FROM r WHERE k = 1 AND n::DOUBLE / total >= 0.35 GROUP BY ALL""".replace(chr(92) * 2, chr(92)))
def language_slices(spark, sf_dir):
    return language.slices(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", table(spark, sf_dir, "stopwords"))


@query("""SELECT doc_id, list(lang ORDER BY n DESC, lang) AS languages FROM (""" + SQL["language_slices"] + """) GROUP BY doc_id""")
def language_order(spark, sf_dir):
    """The languages of a text's slices, most frequent first."""
    return language.ordered_languages(language_slices(spark, sf_dir), "doc_id")


@query()
def language_trigrams(spark, sf_dir):
    """The language of documents by trigram profiles made from the documents' own labels; short lists reach the driver."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", language.iso3(F.col("lang")).alias("label"))
    return language.detect_trigrams(d, "doc_id", "text", language.profiles(d, "label", "text"))


_ISO3 = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in language.ISO3.items())
_NAMES = ", ".join(f"'{v}'" for v in sorted(set(language.ISO3.values())))


@query(f"""SELECT result_id, list_filter(list_transform(detected_languages, lambda c: CASE WHEN x(c) IN ({_NAMES}) THEN x(c) ELSE CASE x(c) {_ISO3} END END), lambda c: c IS NOT NULL) AS languages FROM {_ONE} WHERE detected_languages IS NOT NULL""".replace("x(c)", "regexp_extract(lower(trim(c)), '^([a-z]{2,3})(?:[-_].*)?$', 1)"))
def language_codes(spark, sf_dir):
    rows = _results(spark, sf_dir).filter("detected_languages is not null")
    return rows.select("result_id", F.filter(F.transform("detected_languages", language.iso3), lambda c: c.isNotNull()).alias("languages"))
