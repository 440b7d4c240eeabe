"""Plugins and the pipeline: extractors, processors and validators by stage and priority, composed into one plan.

Processors are DataFrame -> DataFrame functions in the stages early, middle, late; within a stage higher priority
first, then order of registration. A processor has a gate by configuration, which is decided when the plan is built,
and may have one by row, a condition: rows that don't meet it keep null in the columns it makes. Chunks and languages
of the configuration come after the processors; validators run last, and the first failure by priority is the row's
error. The registries are read whenever a plan is built, so later registrations count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from papyra.config import Chunking, Extraction, Keywords, LanguageDetection
from papyra.functions import text as X
from papyra.functions.stopwords import FUNCTION_WORDS, built_in

STAGES = ("early", "middle", "late")


@dataclass(frozen=True)
class Processor:
    name: str
    stage: str
    priority: int
    apply: Callable[[DataFrame], DataFrame]
    #: Whether the configuration asks for it; without one, always.
    enabled: Callable[[Extraction], bool] = lambda config: True
    #: Which rows it is for; without one, all.
    where: Callable[[DataFrame], Column] | None = None
    #: Milliseconds that a row takes, roughly.
    estimate: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class Validator:
    name: str
    priority: int
    check: Callable[[DataFrame], Column]


@dataclass
class Registry:
    """Named plugins in order of registration."""

    items: dict = field(default_factory=dict)

    def register(self, item) -> None:
        if not item.name or any(c.isspace() for c in item.name):
            raise ValueError("a plugin's name has at least one character and no white space")
        self.items.pop(item.name, None)
        self.items[item.name] = item

    def get(self, name: str):
        return self.items[name]

    def remove(self, name: str) -> None:
        self.items.pop(name, None)

    def clear(self) -> None:
        self.items.clear()

    def names(self) -> list[str]:
        return list(self.items)

    def ordered(self) -> list:
        return sorted(self.items.values(), key=lambda p: -p.priority)


@dataclass(frozen=True)
class OcrBackend:
    """An OCR engine: a function of image bytes and language to text. None is built in."""

    name: str
    priority: int
    languages: tuple[str, ...]
    read: Callable[[bytes, str], str]

    def supports(self, language: str) -> bool:
        return language in self.languages

    def reader(self, language: str) -> Callable[[bytes], tuple[str, dict, list]]:
        """The engine as a reader of image files, with the image's own metadata."""
        from papyra.sources.images import image_metadata

        def run(data: bytes) -> tuple[str, dict, list]:
            try:
                meta = image_metadata(data)
            except ValueError:
                meta = {}
            return self.read(data, language), {**meta, "ocr_backend": self.name, "ocr_language": language}, []

        return run


@dataclass(frozen=True)
class Reader:
    """A plugin for media types, exact ones or a class such as image/*; the highest priority that has a type reads it."""

    name: str
    priority: int
    mimes: tuple[str, ...]
    read: Callable[[bytes], tuple[str, dict, list]]


processors, validators, readers, ocr_backends = Registry(), Registry(), Registry(), Registry()


def chosen_readers(ocr: str | None = None, language: str = "eng") -> dict[str, Callable[[bytes], tuple[str, dict, list]]]:
    """The built-in readers, an OCR engine for images if one is named, and over both the registered ones by priority."""
    from papyra.sources.extractors import READERS

    out = dict(READERS)
    if ocr is not None:
        engine = ocr_backends.get(ocr)
        if not engine.supports(language):
            raise ValueError(f"{ocr} has no language {language}")
        out |= {m: engine.reader(language) for m in READERS if m.startswith("image/") and m != "image/svg+xml"}
    for r in reversed(readers.ordered()):
        out |= dict.fromkeys(r.mimes, r.read)
    return out


def selected(items: list[Processor], allow: set[str] | None = None, deny: set[str] | None = None) -> list[Processor]:
    """The processors that run: the allow list wins over the deny list."""
    if allow is not None:
        return [p for p in items if p.name in allow]
    return [p for p in items if p.name not in (deny or set())]


def run(df: DataFrame, items: list[Processor], checks: list[Validator] | None = None, allow: set[str] | None = None, deny: set[str] | None = None) -> DataFrame:
    """All stages, then the validators; rows keep their other columns."""
    order = sorted(selected(items, allow, deny), key=lambda p: (STAGES.index(p.stage), -p.priority))
    for p in order:
        df = applied(df, p)
    return validate(df, checks or [])


def applied(df: DataFrame, p: Processor) -> DataFrame:
    """The frame with a processor's columns, null in rows that it isn't for."""
    if p.where is None:
        return p.apply(df)
    out = p.apply(df)
    new = [c for c in out.columns if c not in df.columns]
    return out.withColumns({c: F.when(p.where(out), F.col(c)) for c in new})


def estimated_ms(df: DataFrame, items: list[Processor]) -> Column:
    """What the processors that give an estimate take for a row."""
    return sum((p.estimate(df) for p in items if p.estimate), F.lit(0))


def run_configured(df: DataFrame, config: Extraction, content: str = "content", extra: list[Processor] | None = None, checks: list[Validator] | None = None) -> DataFrame:
    """The pipeline as a configuration asks for it: processors, then chunks and languages, then validators.

    Processors are those of the defaults, of the registry and of `extra`, as far as the lists of the configuration and
    their own gates let them run. With post-processing off none runs, chunks and languages do.
    """
    items = {p.name: p for p in [*default_processors(content, config), *processors.items.values(), *(extra or [])]}
    if not config.postprocessor.enabled:
        items = {}
    post = config.postprocessor
    allow = set(post.enabled_processors) if post.enabled_processors is not None else None
    chosen = [p for p in selected(list(items.values()), allow, set(post.disabled_processors or ())) if p.enabled(config)]
    for p in sorted(chosen, key=lambda p: (STAGES.index(p.stage), -p.priority)):
        df = applied(df, p)
    c = F.col(content)
    if config.chunking:
        df = df.withColumn("chunks", chunks_column(c, config.chunking)).withColumn("chunk_count", F.size("chunks"))
    if config.language_detection and config.language_detection.enabled:
        df = df.withColumn("detected_languages", languages_column(c, config.language_detection))
    return validate(df, [*validators.items.values(), *(checks or [])])


def validate(df: DataFrame, checks: list[Validator]) -> DataFrame:
    """Column error: the first failure by priority, null where all pass."""
    ordered = sorted(checks, key=lambda v: -v.priority)
    error = F.coalesce(*[v.check(df).cast("string") for v in ordered], F.lit(None).cast("string")) if ordered else F.lit(None).cast("string")
    return df.withColumn("error", error)


def strict(df: DataFrame) -> DataFrame:
    """Fail the job at the first row with an error."""
    return df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("error")))


def chunks_column(c: Column, settings: Chunking = Chunking()) -> Column:
    """The pieces of a text by the settings."""

    @pandas_udf(ArrayType(StringType()))
    def cut(texts):
        from papyra.operators.chunking import split_text

        return texts.map(lambda t: split_text(t or "", settings.max_chars, settings.max_overlap))

    return cut(c)


def language_column(c: Column) -> Column:
    """The language with most of its function words in a text; null for a text with none. An expression, no shuffle."""

    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"\p{IsLatin}+|\p{IsCyrillic}+|[\x{3040}-\x{309F}]"), F.lit(0))

    def score(lang: str, found: Column) -> Column:
        own = FUNCTION_WORDS[lang].split()
        return F.struct(F.size(F.filter(found, lambda w: w.isin(own))).alias("n"), F.lit(lang).alias("lang"))

    best = X.bind(F.filter(tokens, lambda w: w.isin(every)), lambda found: F.array_max(F.array(*[score(lang, found) for lang in sorted(FUNCTION_WORDS)])))
    return X.bind(best, lambda b: F.when(b["n"] > 0, b["lang"]))


def languages_column(c: Column, settings: LanguageDetection) -> Column:
    """The languages of a text: the one of the whole, or with detect_multiple those of its slices by frequency."""
    from papyra.operators.language import detector

    @pandas_udf(ArrayType(StringType()))
    def found(texts):
        return texts.map(lambda t: detector().languages(t or "", settings.min_confidence, settings.detect_multiple))

    return found(c)


def default_validators(content: str = "content") -> list[Validator]:
    return [Validator("empty", 50, lambda d: F.when(F.coalesce(F.trim(F.col(content)), F.lit("")) == "", F.lit("empty text")))]


def default_processors(content: str = "content", config: Extraction | None = None) -> list[Processor]:
    """Language and quality early, keywords and chunks in the middle; keywords by the settings, in texts of ten words or more."""
    from papyra.operators import keywords

    c = F.col(content)
    settings = config.keywords if config and config.keywords else Keywords()
    stop = built_in({"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "nl": "nld", "pl": "pol", "pt": "por", "ru": "rus", "ja": "jpn"}.get((settings.language or "en")[:2], "eng"))
    words = lambda d: F.coalesce(X.word_count(c), F.lit(0))
    return [
        Processor("language", "early", 40, lambda d: d.withColumn("detected_language", language_column(c)), lambda g: g.language_detection is not None),
        Processor("quality", "early", 30, lambda d: d.withColumn("quality_score", X.quality_score(c)), lambda g: g.enable_quality_processing, estimate=lambda d: F.coalesce(F.octet_length(c), F.lit(0)) / F.lit(100_000)),
        Processor("keywords", "middle", 50, lambda d: d.withColumn("keywords", keywords.column(c, stop, settings)), lambda g: g.keywords is not None, lambda d: words(d) >= 10, lambda d: words(d) / F.lit(100) + F.lit(10)),
        Processor("chunking", "middle", 50, lambda d: d.withColumn("chunks", chunks_column(c, config.chunking if config and config.chunking else Chunking())), lambda g: False, estimate=lambda d: F.coalesce(F.octet_length(c), F.lit(0)) / F.lit(10_000)),
    ]
