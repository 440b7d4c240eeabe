"""Arithmetic that plans work: DPI advice, time and memory estimates, pools and workers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds a megapixel by OCR back end.
BASE_SECONDS = {"tesseract": 2.5, "easyocr": 4.0, "paddleocr": 3.5}
OTHER_SECONDS = 3.0
# Of each media type the expected text by file bytes, pooled strings, and bytes of each.
POOLS = {
    "text/plain": (0.95, 2, 4096), "text/markdown": (0.95, 2, 4096), "text/x-markdown": (0.95, 2, 4096), "text/csv": (0.90, 3, 8192), "text/tab-separated-values": (0.90, 3, 8192),
    "text/html": (0.65, 8, 16384), "application/xml": (0.60, 5, 8192), "text/xml": (0.60, 5, 8192), "image/svg+xml": (0.55, 4, 8192), "application/msword": (0.45, 5, 8192),
    "application/vnd.ms-excel": (0.40, 4, 8192), "application/vnd.ms-powerpoint": (0.35, 4, 8192), "application/vnd.oasis.opendocument.text": (0.45, 5, 8192), "application/vnd.oasis.opendocument.spreadsheet": (0.40, 4, 8192),
    "application/vnd.oasis.opendocument.presentation": (0.35, 4, 8192), "application/pdf": (0.25, 6, 16384), "application/json": (0.80, 4, 8192), "text/json": (0.80, 4, 8192), "application/x-yaml": (0.85, 4, 8192),
    "text/yaml": (0.85, 4, 8192), "application/zip": (0.30, 3, 8192), "application/gzip": (0.25, 3, 8192),
}
OTHER_POOL = (0.50, 3, 8192)


def pool_ratio(mime: Column) -> Column:
    """Expected text by file bytes of a media type."""
    table = F.create_map(*[F.lit(x) for k, v in POOLS.items() for x in (k, v[0])])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))), F.lit(OTHER_POOL[0]))


def pool_size(mime: Column) -> Column:
    """Strings to keep for a media type, times the bytes of each."""
    table = F.create_map(*[F.lit(x) for k, v in POOLS.items() for x in (k, v[1] * v[2])])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))), F.lit(OTHER_POOL[1] * OTHER_POOL[2]))


def dpi_advice(width: Column, height: Column, current: int, target: int, most: int, kind: str = "document") -> Column:
    """struct(recommended_dpi, performance_impact, quality_impact, is_portrait, is_landscape, is_large, notes) of an image in pixels.

    Null sizes give null; a height of zero counts as square.
    """
    ratio = F.when(height > 0, F.try_divide(width.cast("double"), height)).otherwise(F.lit(1.0))
    mega = width.cast("double") * height / 1e6
    memory = width.cast("double") * height * 3 / 1048576.0
    doc = F.lit(kind == "document")
    narrow, big = doc & ((ratio > 2.0) | (ratio < 0.5)), doc & (mega > 50)
    dpi = F.when(big & F.lit(target > 150), F.lit(float(max(120.0, target * 0.8)))).when(narrow & F.lit(target < 200), F.lit(float(min(200.0, target * 1.3)))).otherwise(F.lit(float(target)))
    scale = target / current if current > 0 else 1.0
    slow = big | (memory > 200) | F.lit(scale > 1.5)
    notes = F.filter(
        F.array(
            F.when(narrow, F.lit("narrow document: a higher DPI may help")), F.when(big, F.lit("large document: a lower DPI may help")), F.when(memory > 200, F.concat(F.lit("about "), F.round(memory).cast("bigint").cast("string"), F.lit(" MB of memory"))),
            F.when(F.lit(scale < 0.7), F.lit("strong downscaling may cost accuracy")), F.when(F.lit(scale > 1.5), F.lit("upscaling takes longer")),
        ),
        lambda x: x.isNotNull(),
    )
    advice = F.struct(
        dpi.alias("recommended_dpi"), F.when(slow, "high").otherwise("medium").alias("performance_impact"), F.lit("high" if scale < 0.7 else "medium").alias("quality_impact"), (ratio < 0.8).alias("is_portrait"), (ratio > 1.2).alias("is_landscape"),
        (F.greatest(width, height) > most * 0.8).alias("is_large"), notes.alias("notes"),
    )
    return F.when(width.isNotNull() & height.isNotNull(), advice)


def ocr_seconds(width: Column, height: Column, backend: str = "tesseract") -> Column:
    """Estimated seconds of OCR of an image."""
    mega = width.cast("double") * height / 1e6
    return F.lit(BASE_SECONDS.get(backend, OTHER_SECONDS)) * mega * F.when(mega > 10, 1.0 + (mega - 10) * 0.1).otherwise(1.0)


def workers(tasks: int, cores: int, cpu_bound: bool = True) -> int:
    """Workers for so many tasks: one or few for few tasks, else the cores, and up to twice as many for tasks that wait."""
    if tasks <= 3:
        return max(1, min(tasks, cores))
    return cores if cpu_bound else min(2 * cores, max(cores, tasks))


def partitions(total_bytes: int, cores: int, per_partition: int = 128 << 20) -> int:
    """Partitions for an input: enough that each fits, and at least one a core."""
    return max(cores, math.ceil(total_bytes / per_partition))
