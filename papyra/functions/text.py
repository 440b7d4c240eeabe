"""Text statistics, quality, cleaning, encoding repair and token reduction as Column expressions.

Lengths are UTF-8 bytes unless a name says chars. Null texts give null (counts: 0); empty texts give zeros.
Every expression runs inside whole-stage code generation; regular expressions have Unicode classes, (?U).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of the quality score.
OCR_WEIGHT, SCRIPT_WEIGHT, NAV_WEIGHT, STRUCTURE_WEIGHT, METADATA_WEIGHT = 0.3, 0.2, 0.1, 0.2, 0.1
SHORT_BYTES, LARGE_BYTES = 10, 1000
SENTENCE_WORDS, PARAGRAPH_WORDS = (10.0, 30.0), (50.0, 300.0)
METADATA_KEYS = ("title", "author", "subject", "description", "keywords")

# Patterns of the quality score and of cleaning.
SCATTERED = r"\b[a-zA-Z]\s{2,}[a-zA-Z]\s{2,}[a-zA-Z]\b"
REPEATED = r"[.]{3,}|[_]{3,}"
DASHES = r"[-]{3,}"
ISOLATED = r"\s[.,;:!?]\s"
MALFORMED = r"\b[a-zA-Z]+[0-9]+[a-zA-Z]+[a-zA-Z0-9]*\b"
WIDE_SPACE = r"\s{3,}"
JS_FUNCTION = r"(?i)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}"
CSS_RULE = r"(?i)\.[a-zA-Z][\w-]*\s*\{[^}]*\}"
SCRIPT_TAG = r"(?is)<script[^>]*>.*?</script>"
STYLE_TAG = r"(?is)<style[^>]*>.*?</style>"
NAV_WORDS = r"(?i)\b(?:Skip to main content|Back to top|Main navigation|Site navigation)\b"
BREADCRUMB = r"(?:Home\s*[>»]\s*|[>»]\s*){2,}"
PAGINATION = r"(?i)\b(?:Page \d+ of \d+|First page|Last page|Previous page|Next page|^\d+ of \d+$)\b"
BLANKS = r"[ \t\f\x0B\r\xa0\x{2000}-\x{200b}\x{2028}\x{2029}\x{3000}]+"
MANY_NEWLINES = r"\n\s*\n\s*\n+"
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]"
REPLACEMENT = r"\x{FFFD}+"
COMBINING = r"[\x{0300}-\x{036F}]+"
CYRILLIC = r"[\x{0400}-\x{04FF}]{3,}"

U = "(?U)"


def bind(c: Column, f) -> Column:
    """f of a column whose expression is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(U + pattern), F.lit(by))


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(U + pattern), F.lit(0))


def match_bytes(c: Column, pattern: str) -> Column:
    """Bytes of all matches together: what their removal takes away."""
    return F.octet_length(c) - F.octet_length(replace(c, pattern, ""))


# ---------------------------------------------------------------- counts


def words(c: Column) -> Column:
    """Runs between white space, in order."""
    return F.filter(F.split(c, U + r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def lines(c: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    parts = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(c == "", F.array().cast("array<string>")).when(c.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    return F.size(lines(c))


def average_word_length(c: Column) -> Column:
    """Mean characters of the words' letters and digits; 5 for a text without words."""
    own = F.filter(F.transform(words(c), lambda w: F.length(F.regexp_replace(w, r"[^\pL\pN_\pM]", ""))), lambda n: n > 0)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(own), F.lit(1))).otherwise(F.lit(5.0))


def word_diversity(c: Column) -> Column:
    """Distinct words by words, in lower case; 0 without words."""
    ws = F.transform(words(c), F.lower)
    return F.when(F.size(ws) > 0, F.size(F.array_distinct(ws)) / F.greatest(F.size(ws), F.lit(1))).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- native text statistics

# Limits of the decision to fall back to OCR.
MIN_TOTAL, MIN_PER_PAGE, MIN_WORD, MIN_WORDS, MIN_RATIO = 64, 32.0, 4, 3, 0.3
_NOT_ALNUM = r"[^\pL\pN]"


def ink_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, U + r"\s", ""))


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, _NOT_ALNUM, ""))


def meaningful_words(c: Column) -> Column:
    good = F.filter(words(c), lambda w: F.length(F.regexp_replace(w, _NOT_ALNUM, "")) >= MIN_WORD)
    return F.least(F.lit(MIN_WORDS), F.size(good))


def ocr_fallback(c: Column, pages: Column) -> Column:
    """Whether a native text is so poor that OCR should replace it. Null and blank texts: true."""
    ink, alnum, good = ink_count(c), alnum_count(c), meaningful_words(c)
    n = F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))
    ratio = F.when(ink == 0, F.lit(0.0)).otherwise(alnum / F.greatest(ink, F.lit(1)))
    poor = ((ratio < MIN_RATIO) & (alnum / n < MIN_PER_PAGE)) | ((ink < MIN_TOTAL) & (ink / n < MIN_PER_PAGE))
    return (
        F.when(c.isNull() | (ink == 0) | (alnum == 0), True)
        .when((ink >= MIN_TOTAL) & (ink / n >= MIN_PER_PAGE) & (good >= MIN_WORDS), False)
        .when(poor, True)
        .otherwise((good == 0) & (ink / n < MIN_PER_PAGE))
    )


# ---------------------------------------------------------------- quality


def _table_rule(line: Column) -> Column:
    return F.trim(line).rlike(U + r"^\|[|\-:\s]*\|$")


def dash_bytes(c: Column) -> Column:
    """Bytes of runs of dashes outside the rules of tables."""
    own = F.filter(F.split(c, "\n"), lambda x: ~_table_rule(x))
    return F.aggregate(own, F.lit(0), lambda a, x: a + match_bytes(x, DASHES))


def ocr_penalty(c: Column) -> Column:
    combined = "|".join((SCATTERED, REPEATED, ISOLATED, MALFORMED, WIDE_SPACE))
    share = (match_bytes(c, combined) + dash_bytes(c)) / F.greatest(F.octet_length(c), F.lit(1))
    return F.when(c.contains("  ") | c.contains("..."), F.least(F.lit(1.0), share)).otherwise(F.lit(0.0))


def script_penalty(c: Column) -> Column:
    total = match_bytes(c, JS_FUNCTION) + match_bytes(c, CSS_RULE) + match_bytes(c, SCRIPT_TAG) + match_bytes(c, STYLE_TAG)
    gate = c.contains("function") | c.contains("<script") | c.contains("<style")
    return F.when(gate, F.least(F.lit(1.0), total / F.greatest(F.octet_length(c), F.lit(1)))).otherwise(F.lit(0.0))


def nav_penalty(c: Column) -> Column:
    """Share of navigation; each pattern runs where a text has what every match of it holds."""

    def total(low: Column) -> Column:
        where = lambda ok, p: F.when(ok, match_bytes(c, p)).otherwise(F.lit(0))
        words_ = where(low.contains("main content") | low.contains("back to top") | low.contains("navigation"), NAV_WORDS)
        return words_ + where(c.contains(">") | c.contains("»"), BREADCRUMB) + where(low.contains("page") | c.rlike(U + r"(?i)^\d+ of "), PAGINATION)

    return F.least(F.lit(1.0), bind(F.translate(F.lower(c), "ſ", "s"), total) / F.greatest(F.octet_length(c), F.lit(1)))


def structure_bonus(c: Column) -> Column:
    """From 0 to 1 by words a sentence, words a paragraph, paragraphs and punctuation."""
    n = word_count(c).cast("double")
    sentences = F.greatest(F.size(F.regexp_extract_all(c, F.lit(U + r"[.!?]\s+[A-Z]"), F.lit(0))), F.lit(1))
    # paragraphs are counted as pairs of line feeds that don't overlap, and one more
    paragraphs = F.size(F.split(c, "\n\n", -1)).cast("double")
    score = (
        F.when((n / sentences).between(*SENTENCE_WORDS), 0.3).otherwise(0.0)
        + F.when((n / paragraphs).between(*PARAGRAPH_WORDS), 0.3).otherwise(0.0)
        + F.when(paragraphs > 1, 0.2).otherwise(0.0)
        + F.when(c.rlike("[.!?]"), 0.2).otherwise(0.0)
    )
    return F.when(c.isNull() | (n == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON object or array, whole: as the only item of an array, nothing can follow it."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(t.rlike(r"^[{\[]") & t.rlike(r"[}\]]$") & (F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1), F.lit(False))


def metadata_bonus(json: Column) -> Column:
    """Share of the important keys that a metadata object has; 0 for what is no valid JSON object."""
    ok = valid_json(json) & F.ltrim(json).startswith("{")
    there = sum((F.when(F.get_json_object(json, f"$.{k}").isNotNull(), 1).otherwise(0) for k in METADATA_KEYS), F.lit(0))
    return F.when(ok, there / F.lit(len(METADATA_KEYS))).otherwise(F.lit(0.0))


def quality_score(c: Column, json: Column | None = None) -> Column:
    """0 for null and blank, 0.1 below ten bytes, else penalties and bonuses within 0 and 1."""
    size = F.octet_length(c)
    score = F.lit(1.0) - OCR_WEIGHT * ocr_penalty(c) + STRUCTURE_WEIGHT * structure_bonus(c)
    score = score - F.when(size > LARGE_BYTES, SCRIPT_WEIGHT * script_penalty(c) + NAV_WEIGHT * nav_penalty(c)).otherwise(F.lit(0.0))
    if json is not None:
        score = score + METADATA_WEIGHT * metadata_bonus(json)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(c.isNull() | c.rlike(U + r"^\s*$"), 0.0).when(size < SHORT_BYTES, 0.1).otherwise(score)


# ---------------------------------------------------------------- cleaning


def remove_scripts(c: Column) -> Column:
    for p in (SCRIPT_TAG, STYLE_TAG, JS_FUNCTION, CSS_RULE):
        c = replace(c, p, " ")
    return c


def remove_navigation(c: Column) -> Column:
    for p in (NAV_WORDS, BREADCRUMB, PAGINATION):
        c = replace(c, p, " ")
    return c


def clean_dashes(c: Column) -> Column:
    """Runs of dashes become three dots, but in the rules of tables; a last line feed goes where there were any."""
    kept = F.transform(lines(c), lambda x: F.when(_table_rule(x), x).otherwise(F.regexp_replace(x, DASHES, "...")))
    return F.when(c.rlike(DASHES), F.array_join(kept, "\n")).otherwise(c)


def clean_ocr(c: Column) -> Column:
    """Without the collapse of letter-spaced words, which is collapse_letters."""
    c = clean_dashes(c)
    for p, by in ((REPEATED, "..."), (ISOLATED, " "), (MALFORMED, " "), (WIDE_SPACE, " ")):
        c = replace(c, p, by)
    return c


def collapse_letters(c: Column) -> Column:
    """Three letters spaced out by two or more blanks become one word."""
    return F.regexp_replace(c, U + r"\b([a-zA-Z])\s{2,}([a-zA-Z])\s{2,}([a-zA-Z])\b", "$1$2$3")


def normalize_whitespace(c: Column) -> Column:
    """Blanks to one space, three or more line feeds to two; pure ASCII texts also lose blanks after a line feed."""
    ascii_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t\f\x0B\r]+", " "), r"\n[ \n]*\n[ \n]*\n+", "\n\n"), r"\n +", "\n")
    other = replace(replace(c, BLANKS, " "), MANY_NEWLINES, "\n\n")
    return F.when(F.octet_length(c) == F.length(c), ascii_).otherwise(other)


def clean_text(c: Column) -> Column:
    """Scripts, OCR artefacts, navigation, white space, ends: in this order."""
    c = bind(collapse_letters(remove_scripts(c)), clean_ocr)
    c = bind(remove_navigation(c), normalize_whitespace)
    return replace(c, r"^\s+|\s+$", "")


def normalize_spaces(c: Column) -> Column:
    """Paragraphs with collapsed blanks, trimmed lines and no empty ones."""

    def paragraph(p: Column) -> Column:
        one = F.regexp_replace(replace(p, BLANKS, " "), "\n+", "\n")
        ls = F.filter(F.transform(F.split(one, "\n"), lambda x: replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        return F.array_join(ls, "\n")

    parts = F.filter(F.transform(F.split(c, "\n\n"), paragraph), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def strip_html(c: Column) -> Column:
    """Scripts and styles of one line, then tags, then runs of white space; the dot doesn't cross lines."""
    c = F.regexp_replace(c, r"(?i)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?i)<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    return F.trim(replace(c, r"\s+", " "))


# ---------------------------------------------------------------- encoding


def fix_mojibake(c: Column) -> Column:
    """Without control characters, replacement characters and combining marks."""
    for p in (CONTROL, REPLACEMENT, COMBINING):
        c = F.regexp_replace(c, p, "")
    return c


def strip_control(c: Column) -> Column:
    """Without control characters other than line feed, carriage return and tab."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def text_confidence(c: Column) -> Column:
    """From 0 to 1: readable characters, less replacement and control characters and long Cyrillic runs, by bytes."""
    size = F.greatest(F.octet_length(c), F.lit(1)).cast("double")
    readable = F.length(F.regexp_replace(c, U + r"[^\x21-\x7E\s]", ""))
    bad = F.size(F.regexp_extract_all(c, F.lit(REPLACEMENT), F.lit(0))) + 2 * F.size(F.regexp_extract_all(c, F.lit(CONTROL), F.lit(0)))
    cyrillic = F.aggregate(F.regexp_extract_all(c, F.lit(CYRILLIC), F.lit(0)), F.lit(0), lambda a, x: a + F.octet_length(x))
    score = readable / size - bad / size - F.when(cyrillic > size * 0.1, 0.3).otherwise(0.0)
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def cache_key(parts: dict[str, Column]) -> Column:
    """First 32 hex digits of a hash of the sorted parts."""
    pairs = F.array_sort(F.array(*[F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in parts.items()]))
    return F.substring(F.sha2(F.array_join(pairs, "&"), 256), 1, 32)


# ---------------------------------------------------------------- token reduction


def collapse_punctuation(c: Column) -> Column:
    """Of a run of ! ? . , only the first stays."""
    return F.regexp_replace(c, r"([!?.,])[!?.,]+", "$1")


def reduce_light(c: Column) -> Column:
    """Punctuation runs, comments of one line, runs of spaces, runs of line feeds, ends."""
    c = F.regexp_replace(collapse_punctuation(c), r"<!--.*?-->", "")
    c = F.regexp_replace(F.regexp_replace(c, r" {2,}", " "), r"\n{3,}", "\n\n")
    return replace(c, r"^\s+|\s+$", "")


def kept_word(w: Column, stop: Column) -> Column:
    """Whether a word stays: all capitals or no letters, with a digit, one letter, or not in the list of stop words."""
    core = F.lower(F.regexp_replace(w, r"\PL", ""))
    return (
        ((F.octet_length(w) > 1) & w.rlike(r"^[^a-z\x{80}-\x{10FFFF}]+$"))
        | w.rlike("[0-9]")
        | (F.octet_length(core) <= 1)
        | ~F.array_contains(stop, core)
    )


#: Fenced and inline code.
CODE = r"```[\s\S]*?```|`[^`\n]+`"


def reduce_moderate(c: Column, stop: Column) -> Column:
    """Light, then stop words out; words join by one space; code between backticks is kept as it is.

    Code stands as NUL among the words and comes back in order; NULs of a text with code are dropped before.
    """
    kept = lambda x: F.array_join(F.filter(words(x), lambda w: kept_word(w, stop)), " ")

    def around(x: Column) -> Column:
        codes = F.regexp_extract_all(x, F.lit(CODE), F.lit(0))
        left = F.filter(words(F.regexp_replace(x, CODE, "\x00")), lambda w: w.contains("\x00") | kept_word(w, stop))
        pieces = F.split(F.array_join(left, " "), "\x00")
        return F.array_join(F.zip_with(pieces, F.concat(codes, F.array(F.lit(""))), lambda p, q: F.concat(F.coalesce(p, F.lit("")), F.coalesce(q, F.lit("")))), "")

    return bind(reduce_light(c), lambda x: F.when(x.contains("`"), around(F.replace(x, F.lit("\x00"), F.lit("")))).otherwise(kept(x)))


def cjk_pieces(w: Column) -> Column:
    """Pieces of two characters of a word with Chinese characters, else the word."""
    n = F.length(w)
    cut = F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda i: F.substring(w, i, F.lit(2)))
    return F.when(w.rlike(r"[\x{4E00}-\x{9FFF}]"), cut).otherwise(F.array(w))


# ---------------------------------------------------------------- dates, names, sizes


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDhhmmss to ISO with Z; shorter forms get zeros; what isn't of this form stays."""
    d = F.regexp_extract(c, r"^(?:D:)?(\d{8,14})", 1)
    p = F.rpad(d, 14, "0")
    part = lambda a, n: F.substring(p, a, n)
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))
    return F.when(d != "", iso).otherwise(c)


def split_authors(c: Column) -> Column:
    """Names between semicolons, commas, and the word and."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r" and |[;,]", "\x01"), "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def smart_dpi(width: Column, height: Column, target: int = 300, max_dim: int = 4096, max_mb: float = 2048.0) -> Column:
    """The DPI at which a page (points) stays within a dimension and a memory limit, at least 72."""
    wi, hi = width / 72.0, height / 72.0
    fits = (F.greatest(wi * target, hi * target) <= max_dim) & (wi * target * hi * target * 3 / 1048576.0 <= max_mb)
    by_dim = F.least(F.when(wi > 0, F.round(F.try_divide(F.lit(max_dim), wi))).otherwise(F.lit(target)), F.when(hi > 0, F.round(F.try_divide(F.lit(max_dim), hi))).otherwise(F.lit(target)))
    by_memory = F.when((wi > 0) & (hi > 0), F.floor(F.sqrt(F.try_divide(F.lit(max_mb * 1048576.0 / 3), wi * hi)))).otherwise(F.lit(target))
    return F.when(fits, F.lit(target)).otherwise(F.greatest(F.lit(72), F.least(F.lit(target), by_dim, by_memory))).cast("int")


# Expected text bytes by file bytes.
RATIOS = {"txt": 0.95, "text": 0.95, "md": 0.95, "markdown": 0.95, "html": 0.65, "htm": 0.65, "docx": 0.45, "doc": 0.45, "xlsx": 0.40, "xls": 0.40, "xlsm": 0.40, "xlam": 0.40, "xltm": 0.40, "xlsb": 0.40, "pptx": 0.35, "ppt": 0.35, "pptm": 0.35, "ppsx": 0.35, "pdf": 0.25}


def content_capacity(size: Column, ext: Column) -> Column:
    ratio = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv]), F.lower(ext)), F.lit(0.5))
    return F.ceil(size * ratio).cast("bigint")


#: Fields that metadata has by name; all others are attributes.
KNOWN = ["title", "subject", "authors", "keywords", "language", "created_at", "modified_at", "pages", "format_type", "error"]


def known_fields(metadata: Column) -> tuple[Column, Column]:
    """Names of the known fields of a JSON object, and of its attributes."""
    keys = F.json_object_keys(metadata)
    return F.filter(keys, lambda k: k.isin(KNOWN)), F.filter(keys, lambda k: ~k.isin(KNOWN))


def utf8_ok(data: Column) -> Column:
    """Whether bytes are UTF-8; null for null."""
    return F.is_valid_utf8(data.cast("string"))


def utf8_repaired(data: Column) -> Column:
    """The text of bytes, with the replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def is_image_mime(c: Column) -> Column:
    return F.lower(c).startswith("image/")


def content_type(c: Column) -> Column:
    """A media type without parameters, in lower case."""
    return F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1))))


def l2_normalize(v: Column) -> Column:
    """Vector of length one; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: F.try_divide(x.cast("double"), norm).cast("float"))).otherwise(v)
