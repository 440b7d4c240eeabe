"""Language of texts: by character trigrams in rank order, and by votes of a table of function words.

Trigrams: each language has a profile of its most frequent trigrams, in order; a text's own profile is held against
each by the distance of ranks, and the confidence is how far the best is ahead of the next. Profiles are made from
texts by `profiles`; a small set made from the built-in function words serves where there are none. Languages of
slices are counted, most frequent first.

Results: texts without a letter or a function word have no language; ties go to the code that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from papyra.functions.stopwords import FUNCTION_WORDS

#: Trigrams in a profile, and the characters of a slice.
RANKS, SLICE = 300, 200
_LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> list[str]:
    """A text's trigrams, most frequent first, words with a space on both sides; of scripts without spaces also pairs."""
    counts: Counter = Counter()
    for w in _LETTERS.findall(text.lower()):
        padded = f" {w} "
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(counts, key=lambda g: (-counts[g], g))[:RANKS]


class Detector:
    """Profiles of languages, by rank of each trigram."""

    def __init__(self, profiles: dict[str, list[str]]):
        self.ranks = {lang: {g: i for i, g in enumerate(gs)} for lang, gs in sorted(profiles.items())}

    def scores(self, text: str) -> list[tuple[float, str]]:
        """(share of the largest distance that is left, language), best first; none for a text without letters."""
        own = trigrams(text)
        if not own:
            return []
        worst = RANKS * len(own)
        out = [(1 - sum(abs(i - ranks.get(g, i + RANKS)) for i, g in enumerate(own)) / worst, lang) for lang, ranks in self.ranks.items()]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def one(self, text: str, least: float = 0.0) -> tuple[str, float] | None:
        """The language of a text and its confidence: 1 where the next best has nothing, 0 where it is as good."""
        found = self.scores(text)
        if not found or found[0][0] <= 0:
            return None
        first, second = found[0][0], found[1][0] if len(found) > 1 else 0.0
        sure = min(1.0, (first - max(0.0, second)) / first * 5)
        return (found[0][1], sure) if sure >= least else None

    def slices(self, text: str, least: float) -> list[tuple[str, int]]:
        """Languages of a text's slices by their number, equal ones by code."""
        count = Counter(got[0] for i in range(0, len(text), SLICE) if (got := self.one(text[i : i + SLICE], least)))
        return sorted(count.items(), key=lambda x: (-x[1], x[0]))

    def languages(self, text: str, least: float = 0.8, multiple: bool = False) -> list[str] | None:
        """The language of a text, or of its slices with a threshold of 0.35 at most; falls back to the one of the whole."""
        if not text.strip():
            return None
        if multiple and (found := self.slices(text, min(least, 0.35))):
            return [lang for lang, _ in found]
        one = self.one(text, least)
        return [one[0]] if one else None


@cache
def detector() -> Detector:
    """The profiles of the built-in function words, each counted by its place in the list."""
    return Detector({lang: trigrams(" ".join(w for i, w in enumerate(ws.split()) for _ in range(max(1, 12 - i)))) for lang, ws in FUNCTION_WORDS.items()})


def profiles(df: DataFrame, lang: str, text: str) -> dict[str, list[str]]:
    """The profile of each language from labelled texts: trigrams counted over all of them, RANKS for each language reach the driver."""
    words = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\pL+"), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("p", F.concat(F.lit(" "), "w", F.lit(" ")))
    grams = counts.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3)))).alias("g"))
    total = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Win.partitionBy("lang").orderBy(F.desc("n"), "g"))
    out: dict[str, list[str]] = {}
    for r in total.withColumn("r", rank).filter(F.col("r") <= RANKS).orderBy("lang", "r").collect():
        out.setdefault(r.lang, []).append(r.g)
    return out


def detect_trigrams(df: DataFrame, key: str, text: str, known: dict[str, list[str]], least: float = 0.0) -> DataFrame:
    """(key, lang, confidence) by trigram profiles; rows without a language don't come out."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Detector(known)
        for batch in batches:
            got = [own.one(t, least) if t else None for t in batch.column(1).to_pylist()]
            at = [i for i, g in enumerate(got) if g]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([got[i][0] for i in at], pa.string()), pa.array([got[i][1] for i in at], pa.float64())], [key, "lang", "confidence"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang string, confidence double")

# Two-letter codes to three-letter codes.
ISO3 = dict(
    x.split(":")
    for x in """af:afr am:amh ar:ara az:aze be:bel bg:bul bn:ben ca:cat cs:ces da:dan de:deu el:ell en:eng eo:epo es:spa et:est fa:fas fi:fin fr:fra gl:glg gu:guj he:heb hi:hin hr:hrv hu:hun hy:hye id:ind it:ita ja:jpn jv:jav ka:kat
    kk:kaz km:khm kn:kan ko:kor ku:kur la:lat lt:lit lv:lav mk:mkd ml:mal mr:mar my:mya ne:nep nl:nld no:nor or:ori pa:pan pl:pol ps:pus pt:por ro:ron ru:rus si:sin sk:slk sl:slv sn:sna sq:sqi sr:srp sv:swe sw:swa ta:tam te:tel
    th:tha tk:tuk tl:tgl tr:tur uk:ukr ur:urd uz:uzb vi:vie xh:xho yi:yid yo:yor zh:zho zu:zul""".split()
)


def iso3(code: Column) -> Column:
    """The three-letter code of a label in two or three letters with any region and case; null for what isn't known."""
    c = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    two = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    return F.when(c.isin(sorted(ISO3.values())), c).otherwise(F.try_element_at(two, c))


def votes(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, lang, n): function words of each language in each text. `words` (lang, word) is a small fixed table."""
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\pL+"), F.lit(0))).alias("word"))
    counts = tokens.groupBy(key, "word").agg(F.count("*").alias("n"))
    return counts.join(words.select("lang", "word").distinct(), "word").groupBy(key, "lang").agg(F.sum("n").alias("n"))


def detect(df: DataFrame, key: str, text: str, words: DataFrame, min_share: float = 0.0) -> DataFrame:
    """(key, lang, confidence): the language with most votes; confidence is its share of all votes."""
    v = votes(df, key, text, words)
    best = v.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "lang")).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.neg") / F.col("total")
    return best.select(key, F.col("b.lang").alias("lang"), share.alias("confidence")).filter(share >= min_share)


def slices(df: DataFrame, key: str, text: str, words: DataFrame, size: int = 200, min_share: float = 0.35) -> DataFrame:
    """(key, lang, n): languages of slices of a text, by number of slices, with a threshold on each."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    parts = df.filter(F.length(text) > 0).select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("no", "part"))
    parts = parts.withColumn("at", F.struct(key, "no"))
    found = detect(parts, "at", "part", words, min_share)
    return found.groupBy(F.col(f"at.{key}").alias(key), "lang").agg(F.count("*").alias("n"))


def ordered_languages(found: DataFrame, key: str) -> DataFrame:
    """(key, languages): those of a text's slices, most frequent first, equal ones by code."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang")))
    return found.groupBy(key).agg(F.transform(listed, lambda x: x["lang"]).alias("languages"))
