"""Column functions over file paths, names and raw bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan import schemas as S
from veilspan.functions.text import strip

# --- fixed values -----------------------------------------------------------
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg")
PDF_EXTENSIONS = (".pdf",)
WORD_EXTENSIONS = (".doc", ".docx")
TEXT_EXTENSIONS = (".txt",)
SUPPORTED_EXTENSIONS = (
    IMAGE_EXTENSIONS + PDF_EXTENSIONS + WORD_EXTENSIONS + TEXT_EXTENSIONS
)
MEDIA_TYPES = ("image/png", "image/jpeg", "application/pdf")

SHA256 = r"\A[0-9a-f]{64}\z"
REVISION = r"\A[0-9a-f]{40}\z"
REPOSITORY = r"\A[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z"

SKIPPED_DIRECTORIES = (
    ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".git", ".idea",
    ".vscode", "build", "dist", "output", "outputs", "tmp", "temp", "htmlcov",
    "node_modules", "coverage",
)
SKIPPED_PREFIX = ".venv-"
SENSITIVE_DIRECTORIES = (
    "private", "evidence", "evidences", "kanit", "kanitlar", "real_data",
    "real_documents",
)
FORBIDDEN_SUFFIXES = (
    ".onnx", ".safetensors", ".pdiparams", ".pdmodel", ".pfx", ".p12", ".pem",
    ".key",
)
ALLOWED_FILES = ("models/README.md", "models/manifest.json")
# ----------------------------------------------------------------------------


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def suffix(path: Column | str) -> Column:
    """Lower-cased extension with its dot; empty for none or for a dot file."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    name = file_name(path)
    head = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(head != "", head).otherwise(name)


def is_supported(path: Column | str) -> Column:
    return suffix(path).isin(*SUPPORTED_EXTENSIONS)


def route(path: Column | str) -> Column:
    """Which workflow handles a file: image, pdf, word, text or null."""
    ext = suffix(path)
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*PDF_EXTENSIONS), "pdf")
        .when(ext.isin(*WORD_EXTENSIONS), "word")
        .when(ext.isin(*TEXT_EXTENSIONS), "text")
    )


def output_path(path: Column | str, directory: Column | str) -> Column:
    """``<directory>/<stem>_REDACTED<ext>``; Word documents become PDFs."""
    ext = suffix(path)
    return F.concat(
        _col(directory),
        F.lit("/"),
        stem(path),
        F.lit("_REDACTED"),
        F.when(ext.isin(*WORD_EXTENSIONS), ".pdf").otherwise(ext),
    )


def default_output_directory(path: Column | str, is_file: Column) -> Column:
    """The parent of a file, or ``<directory>_REDACTED`` next to a directory."""
    path = _col(path)
    return F.when(is_file, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(
        F.concat(path, F.lit("_REDACTED"))
    )


def is_safe_relative_path(path: Column | str) -> Column:
    """Forward slashes only, not absolute, and no ``..`` part.

    Empty and ``.`` parts disappear when a path is normalised, so only a path
    made of nothing else is rejected for them by being blank.
    """
    path = strip(path)
    parts = F.split(path, "/")
    return F.coalesce(
        (path != "")
        & ~path.contains("\\")
        & ~path.startswith("/")
        & ~F.array_contains(parts, ".."),
        F.lit(False),
    )


def is_ascii(value: Column | str) -> Column:
    return _col(value).rlike(r"\A[\x00-\x7f]*\z")


def fingerprint(content: Column | str) -> Column:
    """Hexadecimal SHA-256 of a binary column."""
    return F.sha2(_col(content), 256)


def image_format(content: Column | str) -> Column:
    """Format told by the leading bytes."""
    head = F.hex(F.substring(_col(content), 1, 8))
    return (
        F.when(head == "89504E470D0A1A0A", "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("255044462D"), "application/pdf")
    )


def png_size(content: Column | str) -> Column:
    """``struct<width,height>`` from the header chunk of a PNG."""
    content = _col(content)

    def number(offset: int) -> Column:
        return F.conv(F.hex(F.substring(content, offset, 4)), 16, 10).cast("long")

    return F.when(
        (image_format(content) == "image/png") & (F.length(content) >= 24),
        F.struct(number(17).alias("width"), number(21).alias("height")),
    )


def upload_reject_reason(
    content: Column | str,
    media_type: Column | str,
    width: Column | str,
    height: Column | str,
    max_bytes: int = S.MAX_UPLOAD_BYTES,
    max_pixels: int = S.MAX_IMAGE_PIXELS,
) -> Column:
    """Why an upload is refused; null for an accepted one.

    ``width`` and ``height`` come from the PNG header or the image reader and
    are ignored for PDFs, whose pages are checked by ``page_reject_reason``.
    """
    content, media_type = _col(content), _col(media_type)
    width, height = _col(width).cast("long"), _col(height).cast("long")
    size = F.length(content)
    is_image = media_type.startswith("image/")
    return (
        F.when(~media_type.isin(*MEDIA_TYPES) | media_type.isNull(), "unsupported_media_type")
        .when(size.isNull() | (size == 0), "empty")
        .when(size > max_bytes, "too_large")
        .when(
            is_image & (width.isNull() | height.isNull() | (width <= 0) | (height <= 0)),
            "not_an_image",
        )
        .when(is_image & (width * height > max_pixels), "too_many_pixels")
        .when(~image_format(content).eqNullSafe(media_type), "format_mismatch")
    )


def rendered_pixels(points: Column | str, dpi: int = S.PDF_DPI) -> Column:
    """Pixel extent of a page side given in points."""
    return F.ceil(_col(points) * F.lit(dpi / 72.0)).cast("long")


def page_reject_reason(
    width_pt: Column | str,
    height_pt: Column | str,
    dpi: int = S.PDF_DPI,
    max_pixels: int = S.MAX_IMAGE_PIXELS,
) -> Column:
    pixels = rendered_pixels(width_pt, dpi) * rendered_pixels(height_pt, dpi)
    return F.when(pixels > max_pixels, "too_many_pixels")


def page_count_reject_reason(
    page_count: Column | str, max_pages: int = S.MAX_PDF_PAGES
) -> Column:
    count = _col(page_count)
    return F.when(count < 1, "no_pages").when(count > max_pages, "too_many_pages")
