"""Host and path of a url, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What stands after the first ``://``; empty where there is none."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1)
