"""papyra: document analytics on Spark - one row per document, every operator DataFrame -> DataFrame.

The public functions: extraction of files and of bytes, the pipeline, plugins, media types, token reduction, keywords,
chunks and languages. They are looked up when they are first used, so that importing the package is cheap.
"""

from importlib import import_module

__version__ = "0.2.0"

_PUBLIC = {
    "read_files": "papyra.sources.files", "stream_files": "papyra.sources.files", "extract_files": "papyra.sources.files", "process_files": "papyra.sources.files", "in_input_order": "papyra.sources.files",
    "extract": "papyra.sources.extractors", "read_one": "papyra.sources.extractors", "guard": "papyra.sources.extractors", "image_metadata": "papyra.sources.images", "inline_images": "papyra.sources.images",
    "hocr_markdown": "papyra.sources.markup", "arrow_markdown": "papyra.sources.markup", "by_extension": "papyra.sources.mime", "sniff_bytes": "papyra.sources.mime", "sniff_text": "papyra.sources.mime",
    "safe_decode": "papyra.functions.encoding", "reduce_text": "papyra.functions.reduce", "reduce": "papyra.functions.reduce", "quality_score": "papyra.functions.text", "clean_text": "papyra.functions.text",
    "split_text": "papyra.operators.chunking", "split_markdown": "papyra.operators.chunking", "chunk": "papyra.operators.chunking", "rake": "papyra.operators.keywords", "yake": "papyra.operators.keywords", "extract_keywords": "papyra.operators.keywords",
    "detector": "papyra.operators.language", "detect_trigrams": "papyra.operators.language", "reconstruct": "papyra.operators.tables", "nested_triples": "papyra.operators.nested", "nested_tables": "papyra.operators.nested",
    "run_configured": "papyra.plans.pipeline", "Processor": "papyra.plans.pipeline", "Validator": "papyra.plans.pipeline", "OcrBackend": "papyra.plans.pipeline", "processors": "papyra.plans.pipeline", "validators": "papyra.plans.pipeline", "ocr_backends": "papyra.plans.pipeline",
    "readers": "papyra.plans.pipeline", "Extraction": "papyra.config", "Chunking": "papyra.config", "Keywords": "papyra.config", "LanguageDetection": "papyra.config", "load_config": "papyra.config", "discover": "papyra.config",
}
_OTHER_NAME = {"extract_keywords": "extract", "load_config": "load"}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(import_module(_PUBLIC[name]), _OTHER_NAME.get(name, name))
