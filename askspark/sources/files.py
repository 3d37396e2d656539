"""Delimited files, text documents, web pages, images and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.functions.text import asset_family, file_extension, image_mime, page_text

BAD_BYTES = "\N{REPLACEMENT CHARACTER}"  # what undecodable bytes become
MAX_ATTACHMENT_MB = 50.0


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without ``schema`` the types are inferred, which reads the data twice; pass it for large files."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file (page 1 of its document). Undecodable bytes are dropped, blank files left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    value = F.col("value")
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit(BAD_BYTES), F.lit("")))
    return raw.select(
        F.md5(F.col("_metadata.file_path")).alias("doc_id"),
        F.lit(1).alias("page"),
        text.alias("text"),
        F.col("_metadata.file_path").alias("source"),
    ).where(F.rlike("text", F.lit(r"(?U)\S")))


def extract_page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Readable text of fetched web pages; pages without any are left out."""
    # A filter on the text would be moved below and evaluate it twice; a generator keeps one evaluation.
    readable = F.filter(F.array(page_text(F.col(html_col))), lambda t: t != "")
    return pages.select(
        F.col(id_col).alias("doc_id"), F.lit(1).alias("page"), F.explode(readable).alias("text"), F.col(url_col).alias("source")
    )


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Path, extension, MIME type and base64 payload of image files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extension = file_extension(F.col("path"))
    return files.select(
        "path",
        extension.alias("extension"),
        image_mime(extension).alias("mime"),
        F.base64("content").alias("payload"),
    )


def attachment_manifest(spark: SparkSession, path: str, max_mb: float = MAX_ATTACHMENT_MB) -> DataFrame:
    """What each file is and whether it may be attached; only file listings are read, not the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    extension = file_extension(F.col("path"))
    size_mb = F.col("length") / (1024 * 1024)
    # An image handler is chosen by extension only; the bare names "url", "image" and "mysql" are no file extensions.
    family = F.when(F.startswith(extension, F.lit(".")), asset_family(extension)).otherwise("unsupported")
    too_large = size_mb > max_mb
    return files.select(
        "path",
        extension.alias("extension"),
        family.alias("handler"),
        F.col("length").alias("n_bytes"),
        too_large.alias("over_limit"),
        F.when(too_large, F.format_string(f"File too large: %.1fMB (limit {max_mb}MB)", size_mb))
        .when(family == "unsupported", F.concat(F.lit("Extension '"), extension, F.lit("' not supported.")))
        .alias("reason"),
    )
