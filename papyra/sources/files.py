"""Files as a source: folders of any depth to rows of path, size, time, media type and bytes; batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.config import Extraction
from papyra.sources import extractors, mime


def read_files(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, size, modified, mime_type, data. Filters on path, size and time prune files before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(folder))


def stream_files(spark: SparkSession, folder: str, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).schema(schema).load(folder))


def _named(df: DataFrame) -> DataFrame:
    found = F.coalesce(mime.by_extension(F.col("path")), mime.sniff_bytes(F.col("content")))
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), found.alias("mime_type"), F.col("content").alias("data"))


def by_extension(df: DataFrame, ext: str) -> DataFrame:
    """Files with an extension, whatever its case."""
    return df.filter(mime.extension(F.col("path")) == ext.lower().lstrip("."))


def extract_files(df: DataFrame) -> DataFrame:
    """One row of content, metadata, tables and error for each file; unreadable files are rows with an error."""
    return extractors.extract(df, ["path", "size"])


def process_files(df: DataFrame, config: Extraction | None = None, checks: list | None = None) -> DataFrame:
    """Extraction with the registered readers, then the pipeline as the configuration asks for it."""
    from papyra.plans.pipeline import chosen_readers, run_configured

    own = config or Extraction()
    found = extractors.extract(df, ["path", "size"], readers=chosen_readers(own.ocr.backend if own.ocr and own.force_ocr else None, own.ocr.language if own.ocr else "eng"))
    out = run_configured(found.withColumnRenamed("error", "read_error"), own, checks=checks)
    return out.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")


def missing_files(inputs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """A row with an error for each path asked for that isn't there."""
    gone = inputs.join(files.select(key), key, "left_anti").select(key)
    return gone.withColumns({"content": F.concat(F.lit("Error: no such file: "), F.col(key)), "error": F.lit("FileNotFoundError")})


def detect_or_validate(path: Column, given: Column | None = None, data: Column | None = None) -> Column:
    """struct(mime_type, error): the type that was given, or by extension, or by content; unknown and unsupported ones are errors."""
    found = F.coalesce(*[x for x in (F.nullif(given, F.lit("")) if given is not None else None, mime.by_extension(path), mime.sniff_bytes(data) if data is not None else None, F.lit(None).cast("string")) if x is not None])
    known = found.isin(mime.SUPPORTED) | found.startswith("image/")
    error = F.when(found.isNull(), F.concat(F.lit("no media type for "), path)).when(~known, F.concat(F.lit("unsupported media type "), found))
    return F.struct(found.alias("mime_type"), error.alias("error"))


def in_input_order(results: DataFrame, inputs: DataFrame, key: str = "path") -> DataFrame:
    """Results in the order of a list of inputs (key, input_index)."""
    return inputs.join(results, key, "left").orderBy("input_index")
