"""Configuration: frozen dataclasses with the defaults, validation, loading from TOML, YAML or JSON, merging."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1000
    max_overlap: int = 200

    def __post_init__(self) -> None:
        if self.max_chars <= 0 or self.max_overlap < 0 or self.max_overlap >= self.max_chars:
            raise ValueError("chunks need a positive size and an overlap below it")


@dataclass(frozen=True)
class LanguageDetection:
    enabled: bool = True
    min_confidence: float = 0.8
    detect_multiple: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")


@dataclass(frozen=True)
class Keywords:
    algorithm: str = "yake"
    max_keywords: int = 10
    min_score: float = 0.0
    ngram_range: tuple[int, int] = (1, 3)
    language: str = "en"
    window: int = 2
    min_length: int = 1
    max_words: int = 3

    def __post_init__(self) -> None:
        if self.algorithm not in ("yake", "rake") or self.max_keywords < 1 or self.ngram_range[0] < 1 or self.ngram_range[0] > self.ngram_range[1]:
            raise ValueError("keywords need yake or rake, a positive number and an ordered range")


@dataclass(frozen=True)
class Images:
    target_dpi: int = 300
    max_dimension: int = 4096
    min_dpi: int = 72
    max_dpi: int = 600

    def __post_init__(self) -> None:
        if not self.min_dpi <= self.target_dpi <= self.max_dpi or self.max_dimension <= 0:
            raise ValueError("the target DPI lies between the least and the most, and dimensions are positive")


@dataclass(frozen=True)
class Ocr:
    backend: str = "tesseract"
    language: str = "eng"
    psm: int = 3
    oem: int = 3
    output_format: str = "text"

    def __post_init__(self) -> None:
        if self.backend not in ("tesseract", "easyocr", "paddleocr") or not 0 <= self.psm <= 13 or not 0 <= self.oem <= 3 or self.output_format not in ("text", "markdown", "hocr", "tsv"):
            raise ValueError("the OCR settings are out of range")


@dataclass(frozen=True)
class TokenReduction:
    mode: str = "off"
    preserve_code: bool = True
    preserve_markdown: bool = False
    threshold: float = 0.3

    def __post_init__(self) -> None:
        if self.mode not in ("off", "light", "moderate", "aggressive", "maximum"):
            raise ValueError("the mode is off, light, moderate, aggressive or maximum")


@dataclass(frozen=True)
class Pages:
    extract_pages: bool = False
    insert_markers: bool = False
    marker_format: str = "\n\n<!-- PAGE {page_num} -->\n\n"


@dataclass(frozen=True)
class Postprocessor:
    enabled: bool = True
    enabled_processors: tuple[str, ...] | None = None
    disabled_processors: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Extraction:
    use_cache: bool = True
    enable_quality_processing: bool = True
    force_ocr: bool = False
    chunking: Chunking | None = None
    language_detection: LanguageDetection | None = None
    keywords: Keywords | None = None
    images: Images | None = None
    ocr: Ocr | None = None
    token_reduction: TokenReduction | None = None
    pages: Pages | None = None
    postprocessor: Postprocessor = field(default_factory=Postprocessor)


PARTS = {"chunking": Chunking, "language_detection": LanguageDetection, "keywords": Keywords, "images": Images, "ocr": Ocr, "token_reduction": TokenReduction, "pages": Pages, "postprocessor": Postprocessor}


def of_dict(d: dict) -> Extraction:
    """Unknown keys are refused by name."""
    out = {}
    for k, v in d.items():
        if k in PARTS and isinstance(v, dict):
            v = PARTS[k](**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()})
        out[k] = v
    return Extraction(**out)


def load(path: str | Path) -> Extraction:
    text = Path(path).read_text()
    kind = Path(path).suffix.lower()
    if kind == ".toml":
        return of_dict(tomllib.loads(text))
    if kind in (".yaml", ".yml"):
        import yaml

        return of_dict(yaml.safe_load(text) or {})
    return of_dict(json.loads(text))


def discover(start: str | Path, name: str = "papyra.toml") -> Extraction | None:
    """The nearest configuration file in a folder or those above it."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (folder / name).exists():
            return load(folder / name)
    return None


def to_json(config: Extraction) -> str:
    return json.dumps(dataclasses.asdict(config), default=list, sort_keys=True)


def get(config: Extraction, path: str):
    """A field by its dotted path; None where a part of the path is unset."""
    node = config
    for part in path.split("."):
        node = getattr(node, part, None)
    return node


def merge(base: Extraction, other: Extraction) -> Extraction:
    """`base` with those fields of `other` that differ from the defaults."""
    plain = Extraction()
    changed = {f.name: getattr(other, f.name) for f in dataclasses.fields(other) if getattr(other, f.name) != getattr(plain, f.name)}
    return dataclasses.replace(base, **changed)
