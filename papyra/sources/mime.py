"""Media types: by extension, by content, validation and reverse lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import valid_json

# Media types by extension.
BY_EXTENSION = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "pdf": "application/pdf", "html": "text/html", "htm": "text/html",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroEnabled.12", "xlam": "application/vnd.ms-excel.addin.macroEnabled.12", "xla": "application/vnd.ms-excel.template.macroEnabled.12",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "odt": "application/vnd.oasis.opendocument.text",
    "bmp": "image/bmp", "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp",
    "jp2": "image/jp2", "jpx": "image/jpx", "jpm": "image/jpm", "mj2": "image/mj2", "pnm": "image/x-portable-anymap", "pbm": "image/x-portable-bitmap", "pgm": "image/x-portable-graymap", "ppm": "image/x-portable-pixmap",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "yaml": "application/x-yaml", "yml": "application/x-yaml", "toml": "application/toml", "xml": "application/xml", "svg": "image/svg+xml",
    "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "tgz": "application/x-tar", "7z": "application/x-7z-compressed",
    "rst": "text/x-rst", "org": "text/x-org", "epub": "application/epub+zip", "rtf": "application/rtf", "bib": "application/x-bibtex", "ipynb": "application/x-ipynb+json", "tex": "application/x-latex", "latex": "application/x-latex",
    "typst": "application/x-typst", "commonmark": "text/x-commonmark",
}

# Further media types that are supported, besides those above and any image.
FURTHER = [
    "text/x-markdown", "application/csl+json", "application/docbook+xml", "application/x-biblatex", "application/x-endnote+xml", "application/x-fictionbook+xml", "application/x-jats+xml",
    "application/xml+opml", "application/x-opml+xml", "application/x-research-info-systems", "text/troff", "text/x-dokuwiki", "text/x-gfm", "text/x-markdown-extra", "text/x-mdoc",
    "text/x-multimarkdown", "text/x-opml", "text/x-pod", "text/json", "text/yaml", "text/x-yaml", "application/yaml", "text/toml", "text/xml", "application/x-zip-compressed",
]

SUPPORTED = sorted({*BY_EXTENSION.values(), *FURTHER})

#: First bytes (hex) of binary formats.
MAGIC = [
    ("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("377ABCAF271C", "application/x-7z-compressed"), ("7B5C727466", "application/rtf"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
]


def extension(path: Column) -> Column:
    """Extension in lower case, the empty string without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def by_extension(path: Column) -> Column:
    """Media type of a path, null where its extension isn't known."""
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.try_element_at(known, extension(path))


def is_supported(mime: Column) -> Column:
    return F.coalesce(mime.isin(SUPPORTED) | mime.startswith("image/"), F.lit(False))


def sniff_text(text: Column) -> Column:
    """Type of a text: JSON that parses, then anything that begins with "<" is XML, then PDF, else plain text."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    json = valid_json(t)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(json, "application/json")
        .when(t.startswith("<"), "application/xml")
        .when(t.startswith("%PDF"), "application/pdf")
        .otherwise("text/plain")
    )


def sniff_bytes(data: Column) -> Column:
    """Type by the first bytes, then by the text they decode to; null for what is neither."""
    head = F.hex(F.substring(data, 1, 16))
    out = F.when(data.isNull(), F.lit(None).cast("string"))
    for sign, mime in MAGIC:
        out = out.when(head.startswith(sign), mime)
    text = data.cast("string")
    return out.when(F.is_valid_utf8(text), sniff_text(text))


def detect_or_validate(given: Column, path: Column) -> Column:
    """The given type if it is supported, else the path's, else null."""
    found = F.coalesce(given, by_extension(path))
    return F.when(is_supported(found), found)


def extensions_of(spark: SparkSession) -> DataFrame:
    """(mime, extensions): the reverse lookup."""
    table = spark.createDataFrame(list(BY_EXTENSION.items()), "ext string, mime string")
    return table.groupBy("mime").agg(F.array_sort(F.collect_set("ext")).alias("extensions"))
