"""Stop words by language: a table of lists, regional codes, custom words and a whitelist.

The lists come as a table (lang, word), from a file or a frame; a short list of function words of the languages of the
pipeline is built in, so that extraction works without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of each language, which also tell the language in the default pipeline.
FUNCTION_WORDS = {
    "deu": "der die das und ist nicht mit von dem den ein eine zu auf für", "eng": "the of and to in is was for on with that this it as are", "fra": "le la les des une est dans pour qui que et du au sur par",
    "ita": "il della una che per di nel sono è un gli la e con del", "nld": "de het een van en is niet voor dat zijn op met te aan er", "pol": "nie na do jest się że w z i oraz to dla po od", "por": "o os da do uma não para com que em na no as um e",
    "rus": "и в на не что с по из для как это все после", "spa": "el los las una del que no para con en la y por es al", "jpn": "は が を に で の と",
}
# Fixed value: words that are never stop words in English.
KEPT = ["hello", "test", "world", "working", "great"]
# The languages that stop words are known for, by two-letter code.
LANGUAGES = "af ar bg bn br ca cs da de el en eo es et eu fa fi fr ga gl gu ha he hi hr hu hy id it ja kn ko ku la lt lv ml mr ms ne nl no pl pt ro ru si sk sl so st sv sw ta te th tl tr uk ur vi yo zh zu".split()


def normalized(code: Column) -> Column:
    """A language code without region and case: what stands before - or _, else the first two characters."""
    low = F.lower(F.trim(code))
    head = F.regexp_extract(low, r"^([^-_]+)[-_]", 1)
    return F.when(head != "", head).otherwise(F.substring(low, 1, 2))


def supported(code: Column) -> Column:
    return normalized(code).isin(LANGUAGES)


def lists(words: DataFrame, custom: dict[str, list[str]] | None = None, kept: list[str] | None = None) -> DataFrame:
    """(lang, stop): one row a language, words in lower case, with custom words of that language and without the kept ones."""
    rows = words.select("lang", F.lower("word").alias("word"))
    extra = [(lang, w.lower()) for lang, ws in (custom or {}).items() for w in ws]
    if extra:
        rows = rows.unionByName(words.sparkSession.createDataFrame(extra, "lang string, word string"))
    out = rows.groupBy("lang").agg(F.array_sort(F.collect_set("word")).alias("stop"))
    return out.withColumn("stop", F.array_except("stop", F.array(*[F.lit(w) for w in (KEPT if kept is None else kept)])))


def built_in(code: str) -> list[str]:
    """The function words of a language by three-letter code; those of English where there are none."""
    return FUNCTION_WORDS.get(code, FUNCTION_WORDS["eng"]).split()
