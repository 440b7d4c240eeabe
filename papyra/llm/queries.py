"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.plans.text_queries import WS, trim_sql
from papyra.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.pii import find_mentions, name_words

    results, mails = table(spark, sf_dir, "extraction_results"), table(spark, sf_dir, "email_metadata")
    words = name_words(mails)
    found = find_mentions(results, "result_id", "content", "content", words)
    found = found.unionByName(find_mentions(mails, "result_id", "from_email", "from_email", words))
    found = found.unionByName(find_mentions(mails, "result_id", "to_emails", "to_emails", words))
    return found.select("result_id", "field", "item_no", "char_start", "pii_kind")


@query
def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.pii import name_words, redact

    results, mails = table(spark, sf_dir, "extraction_results"), table(spark, sf_dir, "email_metadata")
    words = name_words(mails)
    parts = [redact(df, "result_id", field, words).withColumn("field", F.lit(field)) for df, field in ((results, "content"), (mails, "from_email"), (mails, "to_emails"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("result_id", "field", "item_no", "redacted", "n_mentions")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.textclass import classify

    classes = classify(table(spark, sf_dir, "extraction_results"))
    return classes.filter("text_class <> 'prose'").select("result_id", "text_class")


@query
def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and plain shares of the statistics, which SQL can hold."""
    from papyra.llm.textclass import statistics

    s = statistics(table(spark, sf_dir, "extraction_results"))
    return s.select("result_id", "n_chars", "n_lines", F.round(F.when(F.col("n_chars") > 0, F.col("digit_ratio")).otherwise(F.lit(0.0)), 3).alias("digit_ratio"))


@query
def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.textclass import statistics

    return statistics(table(spark, sf_dir, "extraction_results"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.langseg import segment

    return segment(table(spark, sf_dir, "extraction_results")).select("result_id", "block_no", "lang")


@query
def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.langseg import segment

    return segment(table(spark, sf_dir, "extraction_results"), only_findings=False)


@query
def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.langseg import stretches

    return stretches(table(spark, sf_dir, "extraction_results"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.split import split_oversized

    return split_oversized(table(spark, sf_dir, "chunks"), with_pieces=False).filter("piece_no = 0").select("chunk_id", "cut_at").distinct()


@query
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.split import split_oversized

    return split_oversized(table(spark, sf_dir, "chunks"))


@query
def p5_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each oversized chunk's pieces keep their promises: size, places, order, sharing, and that nothing but white space is left out."""
    from pyspark.sql import Window

    from papyra.llm.split import WHITE, split_oversized

    chunks = table(spark, sf_dir, "chunks").filter(F.length("content") > 1000).select("chunk_id", F.col("content").alias("whole")).dropDuplicates(["chunk_id"])
    p = split_oversized(table(spark, sf_dir, "chunks")).join(chunks, "chunk_id")
    by = Window.partitionBy("chunk_id").orderBy("piece_no")  # pieces of one chunk
    before, start = F.lag("char_end").over(by), F.lag("char_start").over(by)
    gap = F.when(F.col("char_start") > before, F.expr("substring(whole, int(before) + 1, int(char_start - before))")).otherwise(F.lit(""))
    p = p.withColumns({"before": before, "start_before": start}).withColumn("gap", gap)
    octets = F.expr("substring(cast(whole as binary), int(byte_start) + 1, int(byte_end - byte_start))")
    return p.groupBy("chunk_id").agg(
        (F.max(F.length("content")) <= 1000).alias("fits"), F.min(octets == F.col("content").cast("binary")).alias("in_place"), F.min(F.coalesce(F.col("char_start") > F.col("start_before"), F.lit(True))).alias("in_order"),
        (F.max(F.coalesce(F.col("before") - F.col("char_start"), F.lit(0))) <= 200).alias("shares"), (F.max(F.length(F.regexp_replace("gap", f"[{WHITE}]+", ""))) == 0).alias("whole"),
    )


SQL["p5_contract"] = "SELECT DISTINCT chunk_id, true AS fits, true AS in_place, true AS in_order, true AS shares, true AS whole FROM chunks WHERE length(content) > 1000"


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.tokenise import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.mixing import shares

    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.residue import label

    return label(table(spark, sf_dir, "documents")).filter("is_residue").select("doc_id")


@query
def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.residue import label

    return label(table(spark, sf_dir, "documents"))


@query
def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.residue import without_residue

    docs = table(spark, sf_dir, "documents")
    return without_residue(docs).select("doc_id", "source", "lang")


SQL["p2_counts"] = f"""WITH r AS (SELECT DISTINCT result_id, content FROM extraction_results), l AS (SELECT result_id, content, list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: length({trim_sql('x')}) > 0) AS ls FROM r)
  SELECT result_id, coalesce(length(content), 0)::BIGINT AS n_chars, len(ls)::BIGINT AS n_lines, CASE WHEN len(ls) > 0 THEN round(length(regexp_replace(array_to_string(ls, ''), '[^0-9]', '', 'g'))::DOUBLE / list_sum(list_transform(ls, lambda x: length(x))), 3) ELSE 0.0 END AS digit_ratio FROM l"""


def _longest(pieces: str) -> str:
    return f"list_max(list_transform({pieces}, lambda p: length({trim_sql('p')}))) <= 1000"


_SENTENCES = f"replace(regexp_replace(content, '([.!?])({WS})', '\\1' || chr(10) || '\\2', 'g'), '。', '。' || chr(10))"
SQL["p5_found"] = f"""SELECT DISTINCT chunk_id, CASE WHEN {_longest(f"regexp_split_to_array(content, '{chr(92)}n{WS}*{chr(92)}n')")} THEN 'paragraph' WHEN {_longest("string_split(content, chr(10))")} THEN 'line'
  WHEN {_longest(f"string_split({_SENTENCES}, chr(10))")} THEN 'sentence' WHEN {_longest(f"regexp_split_to_array({_SENTENCES}, '{WS}')")} THEN 'word' ELSE 'character' END AS cut_at
  FROM chunks WHERE length(content) > 1000"""
