"""Queries of text statistics, quality, cleaning, encoding and token reduction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.plans.registry import query
from papyra.session import spread, table

#: White space as Unicode defines it, for the SQL engine, whose classes are ASCII.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


W = words_sql("text")


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS n_lines,
  coalesce(len({W}), 0) AS n_words, coalesce(strlen(text), 0) AS n_bytes, coalesce(length(text), 0) AS n_points FROM documents""")
def text_stats(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.line_count(c).cast("bigint").alias("n_lines"), X.word_count(c).cast("bigint").alias("n_words"), F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint").alias("n_bytes"), F.coalesce(F.length(c), F.lit(0)).cast("bigint").alias("n_points"))


_BONUS = f"""CASE WHEN coalesce(len({W}), 0) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE,
  CASE WHEN len({W})::DOUBLE / greatest(len(regexp_extract_all(text, '[.!?]{WS}+[A-Z]')), 1) BETWEEN 10 AND 30 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN len({W})::DOUBLE / len(string_split(text, chr(10)||chr(10))) BETWEEN 50 AND 300 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN len(string_split(text, chr(10)||chr(10))) > 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN regexp_matches(text, '[.!?]') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END"""


@query(f"SELECT doc_id, round({_BONUS}, 6) AS structure_bonus FROM documents")
def structure_bonus(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.structure_bonus(F.col("text")), 6).alias("structure_bonus"))


# The SQL engine's word boundary knows ASCII only: letters, marks and digits beyond it stand as two signs of words that no pattern matches there.
def _bytes(c: str, pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({c}, '{pattern}'), lambda m: strlen(m))), 0)"


def _spaced(pattern: str) -> str:
    return pattern.replace(r"\s", WS)


_OCR = _spaced("|".join((X.SCATTERED, X.REPEATED, X.ISOLATED, X.MALFORMED, X.WIDE_SPACE)))
_WORDLIKE = r"([\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}])"
_PLAIN = f"""array_to_string(list_transform(regexp_extract_all(text, '[\\x00-\\x7F]+|[^\\x00-\\x7F]+'), lambda p: CASE WHEN regexp_matches(p, '^[\\x00-\\x7F]') THEN p ELSE regexp_replace(p, '{_WORDLIKE}', '_0', 'g') END), '')"""
_QUALITY = f"""WITH p AS (SELECT doc_id, lang, text, strlen(text) AS size, coalesce({_PLAIN}, '') AS plain, {_BONUS} AS structure FROM documents),
  q AS (SELECT *, CASE WHEN contains(text, '  ') OR contains(text, '...') THEN least(1.0::DOUBLE, ({_bytes('plain', _OCR)} + coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '^\\|[|\\-:\\s]*\\|$')), lambda l: {_bytes('l', X.DASHES)})), 0))::DOUBLE / greatest(size, 1)) ELSE 0.0::DOUBLE END AS ocr,
  CASE WHEN contains(text, 'function') OR contains(text, '<script') OR contains(text, '<style') THEN least(1.0::DOUBLE, ({_bytes('text', _spaced(X.JS_FUNCTION))} + {_bytes('text', _spaced(X.CSS_RULE))} + {_bytes('text', X.SCRIPT_TAG)} + {_bytes('text', X.STYLE_TAG)})::DOUBLE / greatest(size, 1)) ELSE 0.0::DOUBLE END AS script,
  CASE WHEN text IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({_bytes('plain', X.NAV_WORDS)} + {_bytes('text', _spaced(X.BREADCRUMB))} + {_bytes('plain', X.PAGINATION)})::DOUBLE / greatest(size, 1)) END AS nav FROM p),
  s AS (SELECT *, CASE WHEN text IS NULL OR regexp_full_match(text, '{WS}*') THEN 0.0::DOUBLE WHEN size < 10 THEN 0.1::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - 0.3 * ocr + 0.2 * structure - CASE WHEN size > 1000 THEN 0.2 * script + 0.1 * nav ELSE 0.0 END)) END AS score FROM q)"""


@query(_QUALITY + " SELECT doc_id, round(score, 6) AS score, round(ocr, 6) AS ocr_penalty, round(script, 6) AS script_penalty, round(nav, 6) AS nav_penalty, round(structure, 6) AS structure FROM s")
def quality_score(spark, sf_dir):
    c = F.col("text")
    parts = {"score": X.quality_score(c), "ocr_penalty": X.ocr_penalty(c), "script_penalty": X.script_penalty(c), "nav_penalty": X.nav_penalty(c), "structure": X.structure_bonus(c)}
    return _docs(spark, sf_dir).select("doc_id", *[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in parts.items()])


@query(_QUALITY + " SELECT lower(lang) AS lang, count(*) AS n, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score FROM s GROUP BY 1")
def quality_by_lang(spark, sf_dir):
    scored = _docs(spark, sf_dir).select(F.lower("lang").alias("lang"), X.quality_score(F.col("text")).alias("score"))
    return scored.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("least_score"))


_KEY = " + ".join(f"CASE WHEN json_extract_string(m, '$.{k}') IS NOT NULL THEN 1 ELSE 0 END" for k in X.METADATA_KEYS)


@query(f"""SELECT DISTINCT result_id, round(CASE WHEN m IS NULL THEN 0.0 ELSE ({_KEY}) / 5.0 END, 6) AS metadata_bonus
  FROM (SELECT result_id, CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata), '{{') THEN metadata::JSON END AS m FROM extraction_results)""")
def metadata_bonus(spark, sf_dir):
    rows = table(spark, sf_dir, "extraction_results").select("result_id", F.round(X.metadata_bonus(F.col("metadata")), 6).alias("metadata_bonus"))
    return rows.distinct()


_INK, _ALNUM = f"length(regexp_replace(text, '{WS}', '', 'g'))", r"length(regexp_replace(text, '[^\pL\pN]', '', 'g'))"
_GOOD = rf"least(3, len(list_filter({W}, lambda w: length(regexp_replace(w, '[^\pL\pN]', '', 'g')) >= 4)))"


@query(f"""SELECT doc_id, {_INK}::BIGINT AS ink, {_ALNUM}::BIGINT AS alnum, {_GOOD}::BIGINT AS good_words,
  CASE WHEN text IS NULL OR {_INK} = 0 OR {_ALNUM} = 0 THEN true WHEN {_INK} >= 64 AND {_GOOD} >= 3 THEN false
    WHEN ({_ALNUM}::DOUBLE / {_INK} < 0.3 AND {_ALNUM} < 32) OR ({_INK} < 64 AND {_INK} < 32) THEN true ELSE {_GOOD} = 0 AND {_INK} < 32 END AS fallback FROM documents""")
def ocr_fallback(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.ink_count(c).cast("bigint").alias("ink"), X.alnum_count(c).cast("bigint").alias("alnum"), X.meaningful_words(c).cast("bigint").alias("good_words"), X.ocr_fallback(c, F.lit(1)).alias("fallback"))


@query(rf"""SELECT doc_id, CASE WHEN len(own) > 0 THEN round(list_sum(own)::DOUBLE / len(own), 6) ELSE 5.0 END AS mean_length
  FROM (SELECT doc_id, list_filter(list_transform({W}, lambda w: length(regexp_replace(w, '[^\pL\pN_\pM]', '', 'g'))), lambda n: n > 0) AS own FROM documents)""")
def average_word_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.average_word_length(F.col("text")), 6).alias("mean_length"))


@query(f"SELECT doc_id, CASE WHEN len({W}) > 0 THEN round(len(list_distinct(list_transform({W}, lambda w: lower(w))))::DOUBLE / len({W}), 6) ELSE 0.0 END AS diversity FROM documents")
def word_diversity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.word_diversity(F.col("text")), 6).alias("diversity"))


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_transform({W}, lambda w: lower(w))) AS word FROM documents) GROUP BY ALL")
def word_frequency(spark, sf_dir):
    ws = _docs(spark, sf_dir).select("doc_id", F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("word"))
    return ws.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(least(5.0, -sum(n / total * log2(n / total))), 6) + 0.0 AS entropy FROM (
  SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS total FROM (
    SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch FROM documents WHERE text <> '') WHERE ch <> '' GROUP BY ALL)) GROUP BY doc_id""")
def char_entropy(spark, sf_dir):
    chars = _docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.lower("text"), "")).alias("ch")).filter("ch <> ''")
    counts = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    # the entropy from two sums, so that no window over a document's characters is needed
    sums = counts.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("doc_id", F.round(F.least(F.lit(5.0), F.log2("t") - F.col("s") / F.col("t")), 6).alias("entropy"))


_LIGHT = trim_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([!?.,])[!?.,]+', '\1', 'g'), '<!--.*?-->', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g')")


@query(f"SELECT doc_id, md5({_LIGHT}) AS reduced_md5, length({_LIGHT})::BIGINT AS n FROM documents")
def reduce_light(spark, sf_dir):
    c = X.reduce_light(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(c.cast("binary")).alias("reduced_md5"), F.length(c).cast("bigint").alias("n"))


#: ISO 639-1 of documents to the codes of the stop words.
ISO = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "pl": "pol", "ru": "rus", "ja": "jpn"}
_ISO_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ISO.items())
_CODE = r"```[\s\S]*?```|`[^`\n]+`"
_MODERATE = f"""WITH s AS (SELECT lang, list(word) AS stop FROM stopwords GROUP BY lang),
  d AS (SELECT doc_id, text, {_LIGHT} AS light, CASE lower(lang) {_ISO_SQL} ELSE 'eng' END AS l3 FROM documents),
  h AS (SELECT *, regexp_extract_all(light, '{_CODE}') AS codes, regexp_replace(light, '{_CODE}', chr(1), 'g') AS plain FROM d),
  k AS (SELECT doc_id, text, codes, array_to_string(list_filter({words_sql('plain')}, lambda w: contains(w, chr(1)) OR (strlen(w) > 1 AND regexp_full_match(w, '[^a-z\\x{{80}}-\\x{{10FFFF}}]+')) OR regexp_matches(w, '[0-9]')
    OR strlen(regexp_replace(w, '\\PL', '', 'g')) <= 1 OR NOT list_contains(stop, lower(regexp_replace(w, '\\PL', '', 'g')))), ' ') AS reduced FROM h JOIN s ON s.lang = h.l3),
  r AS (SELECT doc_id, text, array_to_string(list_transform(string_split(reduced, chr(1)), lambda p, i: p || coalesce(codes[i], '')), '') AS reduced FROM k)"""


def _moderate(spark, sf_dir):
    stop = table(spark, sf_dir, "stopwords").groupBy("lang").agg(F.collect_list("word").alias("stop"))  # one row a language
    codes = F.create_map(*[F.lit(x) for kv in ISO.items() for x in kv])
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.coalesce(F.try_element_at(codes, F.lower("lang")), F.lit("eng")).alias("l3"))
    joined = docs.join(stop, docs.l3 == stop.lang)
    return joined.select("doc_id", "text", X.reduce_moderate(F.col("text"), F.col("stop")).alias("reduced"))


@query(_MODERATE + " SELECT doc_id, md5(reduced) AS reduced_md5, length(reduced)::BIGINT AS n FROM r")
def reduce_moderate(spark, sf_dir):
    return _moderate(spark, sf_dir).select("doc_id", F.md5(F.col("reduced").cast("binary")).alias("reduced_md5"), F.length("reduced").cast("bigint").alias("n"))


@query(_MODERATE + f""" SELECT doc_id, length(text)::BIGINT AS chars, length(reduced)::BIGINT AS chars_left, len({W})::BIGINT AS tokens, len({words_sql('reduced')})::BIGINT AS tokens_left,
  CASE WHEN length(text) > 0 THEN round(1 - length(reduced)::DOUBLE / length(text), 6) ELSE 0.0 END AS char_ratio FROM r""")
def reduction_stats(spark, sf_dir):
    c, r = F.col("text"), F.col("reduced")
    ratio = F.when(F.length(c) > 0, F.round(1 - F.try_divide(F.length(r), F.length(c)), 6)).otherwise(F.lit(0.0))
    size = lambda x: F.when(x.isNotNull(), F.size(X.words(x))).cast("bigint")
    return _moderate(spark, sf_dir).select("doc_id", F.length(c).cast("bigint").alias("chars"), F.length(r).cast("bigint").alias("chars_left"), size(c).alias("tokens"), size(r).alias("tokens_left"), ratio.alias("char_ratio"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '\x{FFFD}+', '', 'g'), '[\x{0300}-\x{036F}]+', '', 'g')) AS fixed_md5,
  md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS control_md5 FROM documents""")
def mojibake_fix(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.fix_mojibake(c).cast("binary")).alias("fixed_md5"), F.md5(X.strip_control(c).cast("binary")).alias("control_md5"))


@query(rf"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, length(regexp_replace(text, '[^\x21-\x7E\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g'))::DOUBLE / strlen(text)
  - (len(regexp_extract_all(text, '\x{{FFFD}}+')) + 2 * len(regexp_extract_all(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{{9F}}]')))::DOUBLE / strlen(text)
  - CASE WHEN strlen(array_to_string(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]{{3,}}'), '')) > strlen(text) * 0.1 THEN 0.3 ELSE 0.0 END)), 6) END AS confidence FROM documents""")
def text_confidence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.text_confidence(F.col("text")), 6).alias("confidence"))


@query()
def clean_text(spark, sf_dir):
    both = X.bind(X.clean_text(F.col("text")), lambda c: F.struct(c.alias("cleaned"), X.quality_score(c).alias("score_after")))
    return _docs(spark, sf_dir).select("doc_id", both.alias("b")).select("doc_id", "b.cleaned", "b.score_after")


@query(f"""SELECT doc_id, md5(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda p: array_to_string(list_filter(list_transform(
    string_split(regexp_replace(regexp_replace(p, '[ \\t\\f\\x{{0B}}\\r\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> ''), chr(10))),
    lambda p: p <> ''), chr(10)||chr(10)), '')) AS spaces_md5 FROM documents""")
def normalize_spaces(spark, sf_dir):
    c = F.coalesce(X.normalize_spaces(F.col("text")), F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.md5(c.cast("binary")).alias("spaces_md5"))


@query(f"""SELECT result_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[^>]*>.*?</script>', '', 'g'), '(?i)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'))) AS plain_md5
  FROM (SELECT DISTINCT result_id, '<p class="x">' || replace(content, chr(10), '<br/>') || '</p><script>var a = 1;</script>' AS html FROM extraction_results WHERE content IS NOT NULL)""")
def email_html_clean(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "extraction_results"), "result_id").filter("content is not null")
    html = F.concat(F.lit('<p class="x">'), F.replace(F.col("content"), F.lit("\n"), F.lit("<br/>")), F.lit("</p><script>var a = 1;</script>"))
    return rows.select("result_id", html.alias("html")).distinct().select("result_id", F.md5(X.strip_html(F.col("html")).cast("binary")).alias("plain_md5"))



@query(r"""SELECT doc_id, piece, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN regexp_matches(w, '[\x{4E00}-\x{9FFF}]') THEN list_transform(range(1, length(w) + 1, 2), lambda i: substr(w, i, 2)) ELSE [w] END) AS piece
  FROM (SELECT doc_id, unnest(""" + W + """) AS w FROM documents)) GROUP BY ALL""")
def cjk_tokens(spark, sf_dir):
    ws = _docs(spark, sf_dir).select("doc_id", F.explode(X.words(F.col("text"))).alias("w"))
    return ws.select("doc_id", F.explode(X.cjk_pieces(F.col("w"))).alias("piece")).groupBy("doc_id", "piece").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(sha256('chars=' || coalesce(n_chars::VARCHAR, '') || '&lang=' || coalesce(lang, '') || '&source=' || coalesce(source, '')), 1, 32) AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.cache_key({"source": F.col("source"), "lang": F.col("lang"), "chars": F.col("n_chars")}).alias("cache_key"))
