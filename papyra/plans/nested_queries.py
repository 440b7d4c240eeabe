"""Queries of nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import nested
from papyra.plans.registry import query
from papyra.session import table

NESTED = ["metadata", "tables", "chunks", "pages"]


@query(r"""WITH s AS (SELECT DISTINCT result_id, 'metadata' AS c, CASE WHEN json_type(metadata) = 'VARCHAR' THEN metadata::JSON ->> '$' ELSE metadata END AS j FROM extraction_results WHERE json_valid(metadata)
  UNION SELECT result_id, 'tables', to_json(tables)::VARCHAR FROM extraction_results UNION SELECT result_id, 'chunks', to_json(chunks)::VARCHAR FROM extraction_results UNION SELECT result_id, 'pages', to_json(pages)::VARCHAR FROM extraction_results),
  t AS (SELECT s.result_id, s.c || replace(x.fullkey[2:], '"', '') AS elem_path FROM (SELECT * FROM s WHERE json_valid(j)) s, json_tree(s.j::JSON) x WHERE x.type = 'OBJECT' AND ends_with(x.fullkey, ']'))
  SELECT DISTINCT result_id, elem_path, coalesce(regexp_extract(elem_path, '^(.*\])\.[^\]]*(?:\[[0-9]+\])+$', 1), '') AS parent_path FROM t""".replace(chr(92) * 2, chr(92)))
def p3_found(spark, sf_dir):
    return nested.element_objects(nested.nested_triples(table(spark, sf_dir, "extraction_results"), "result_id", NESTED), "result_id")


@query()
def p3_triples(spark, sf_dir):
    return nested.nested_triples(table(spark, sf_dir, "extraction_results"), "result_id", NESTED)


@query("""WITH p AS (SELECT result_id, generate_subscripts(pages, 1) AS i, unnest(pages) AS page FROM extraction_results WHERE pages IS NOT NULL),
  m AS (SELECT result_id, i, generate_subscripts(page.images, 1) AS j, unnest(page.images) AS im FROM p WHERE page IS NOT NULL AND page.images IS NOT NULL)
  SELECT DISTINCT result_id, 'pages[' || (i - 1) || '].images[' || (j - 1) || ']' AS elem_path, 'pages[' || (i - 1) || ']' AS parent_path, (j - 1)::INTEGER AS ordinal, im.image_index::VARCHAR AS image_index, im.format AS format, im.page_number::VARCHAR AS page_number,
  im.width::VARCHAR AS width, im.height::VARCHAR AS height, im.is_mask::VARCHAR AS is_mask, im.description AS description, im.ocr_result.content AS ocr_result_content, im.ocr_result.mime_type AS ocr_result_mime_type FROM m WHERE im IS NOT NULL""")
def p3_images(spark, sf_dir):
    found = nested.nested_triples(table(spark, sf_dir, "extraction_results"), "result_id", ["pages"])
    fields = ["image_index", "format", "page_number", "width", "height", "is_mask", "description", "ocr_result.content", "ocr_result.mime_type"]
    return nested.nested_table(found, "result_id", "pages[].images[]", fields)


@query("""WITH r AS (SELECT result_id, CASE WHEN json_type(metadata) = 'VARCHAR' THEN metadata::JSON ->> '$' ELSE metadata END AS m FROM extraction_results WHERE json_valid(metadata)),
  b AS (SELECT result_id, json_extract(m, '$.pages.boundaries[*]') AS bs FROM r WHERE json_valid(m)), e AS (SELECT result_id, generate_subscripts(bs, 1) - 1 AS i, unnest(bs) AS x FROM b)
  SELECT DISTINCT result_id, 'metadata.pages.boundaries[' || i || ']' AS elem_path, '' AS parent_path, i::INTEGER AS ordinal, x ->> '$.byte_start' AS byte_start, x ->> '$.byte_end' AS byte_end, x ->> '$.page_number' AS page_number FROM e WHERE json_type(x) = 'OBJECT'""")
def p3_boundaries(spark, sf_dir):
    found = nested.nested_triples(table(spark, sf_dir, "extraction_results"), "result_id", ["metadata"])
    return nested.nested_table(found, "result_id", "metadata.pages.boundaries[]", ["byte_start", "byte_end", "page_number"])


@query()
def p3_tables(spark, sf_dir):
    """The rows of the tables of all groups in one pass, the fields of each as JSON; nested.nested_tables has a table for each group."""
    found = nested.nested_triples(table(spark, sf_dir, "extraction_results"), "result_id", NESTED)
    row = found.groupBy("group_path", "result_id", "elem_path", "parent_path", F.try_element_at("ordinals", F.lit(-1)).alias("ordinal"))
    fields = F.array_sort(F.collect_list(F.when(F.col("kind") != "object", F.struct("field", "value"))))
    return row.agg(F.to_json(fields).alias("fields"))
