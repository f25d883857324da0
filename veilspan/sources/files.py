"""Reading files and writing results; every failure is a row, not a crash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import paths as P
from veilspan.schemas import MAX_IMAGE_PIXELS, MAX_UPLOAD_BYTES

# --- fixed values -----------------------------------------------------------
BYTE_ORDER_MARK = "\ufeff"
# ----------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of a file or directory tree.

    A missing path raises.  Select without ``content`` to list files only; the
    bytes are then never read.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def list_supported(files: DataFrame) -> DataFrame:
    """Supported files in path order."""
    return (
        files.select("path", "length")
        .filter(P.is_supported("path"))
        .orderBy("path")
    )


def route_files(files: DataFrame) -> DataFrame:
    """Add ``route``; ``error`` tells why a file has none."""
    return files.withColumn("route", P.route("path")).withColumn(
        "error",
        F.when(
            F.col("route").isNull(),
            F.concat(F.lit("unsupported file type: "), P.suffix("path")),
        ),
    )


def decode_text(content: Column | str) -> Column:
    """UTF-8 bytes as text: mark removed, line ends unified; null if invalid."""
    raw = F.col(content) if isinstance(content, str) else content
    text = F.decode(raw, "UTF-8")
    unmarked = F.regexp_replace(text, f"^{BYTE_ORDER_MARK}", "")
    return F.when(F.is_valid_utf8(raw.cast("string")), F.regexp_replace(unmarked, r"\r\n?", "\n"))


def read_texts(files: DataFrame, output_directory: Column | str | None = None) -> DataFrame:
    """Text of ``.txt`` files; ``error`` is set where a file cannot be used."""
    directory = (
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        if output_directory is None
        else (F.lit(output_directory) if isinstance(output_directory, str) else output_directory)
    )
    staged = files.withColumn("text", decode_text("content")).withColumn(
        "output_path", P.output_path("path", directory)
    )
    error = (
        F.when(P.suffix("path") != ".txt", "expected a .txt file")
        .when(F.col("path") == F.col("output_path"), "input and output are the same file")
        .when(F.col("text").isNull(), "not valid UTF-8")
    )
    return staged.withColumn("error", error).drop("content")


def write_sanitized(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One parquet row per document, in one folder per status.

    Spark's commit protocol publishes the folder only when every task is done.
    """
    results.write.mode(mode).partitionBy("status").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels; ``valid`` is false for files that cannot be decoded."""
    return (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .load(path)
        .withColumn("valid", F.col("image.height") > 0)
    )


def validate_uploads(
    uploads: DataFrame,
    max_bytes: int = MAX_UPLOAD_BYTES,
    max_pixels: int = MAX_IMAGE_PIXELS,
) -> DataFrame:
    """Add ``accepted`` and ``reject_reason``.

    ``uploads`` has ``content`` and ``media_type``, and ``image_width`` and
    ``image_height`` as decoded, null for formats other than PNG if unknown;
    the size of a PNG comes from its header.
    """
    size = P.png_size("content")
    reason = P.upload_reject_reason(
        "content",
        "media_type",
        F.coalesce(size["width"], F.col("image_width")),
        F.coalesce(size["height"], F.col("image_height")),
        max_bytes,
        max_pixels,
    )
    return uploads.withColumn("reject_reason", reason).withColumn(
        "accepted", F.col("reject_reason").isNull()
    )


def validate_pdf_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Refused PDFs with the first reason, from ``page_no, width_pt, height_pt``."""
    rolled = pages.groupBy(key).agg(
        F.count("page_no").alias("page_count"),
        F.min(
            F.when(P.page_reject_reason("width_pt", "height_pt").isNotNull(), F.col("page_no"))
        ).alias("oversized_page"),
    )
    reason = F.coalesce(
        P.page_count_reject_reason("page_count"),
        F.when(F.col("oversized_page").isNotNull(), "too_many_pixels"),
    )
    return rolled.withColumn("reject_reason", reason)
