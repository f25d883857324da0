"""Redact-and-verify over a table of texts, with no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import find_pii, no_detections, redact_text
from veilspan.operators.detections import add_once, explode_rows
from veilspan.schemas import DEFAULT_MAX_PASSES


def sanitize_texts(
    df: DataFrame,
    text: str = "text",
    max_passes: int = DEFAULT_MAX_PASSES,
    semantic: Callable[[Column], Column] | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Redact until nothing is found or ``max_passes`` is reached.

    Adds ``sanitized_text``, ``redaction_passes`` (0 for clean input),
    ``detections`` (``array<array<..>>``, one inner array per pass; the offsets
    of a pass refer to the text it saw), ``remaining``, and ``status``.  The
    original text column is removed.  A clean text ends the loop for its row.

    ``semantic`` maps a text column to an array of detections.
    """
    if max_passes < 1:
        raise ValueError("max_passes must be at least 1")
    work = _unrolled(df, text, max_passes, semantic)
    applied = F.filter(
        F.array(*(F.col(f"_d{k}") for k in range(max_passes))), lambda d: F.size(d) > 0
    )
    done = add_once(
        work.withColumn("_applied", applied),
        _r=F.struct(
            F.col(f"_t{max_passes}").alias("sanitized_text"),
            F.size("_applied").alias("redaction_passes"),
            F.col("_applied").alias("detections"),
            F.col(f"_d{max_passes}").alias("remaining"),
        ),
    )
    names = ("sanitized_text", "redaction_passes", "detections", "remaining")
    fields = {name: F.col(f"_r.{name}") for name in names}
    if not keep_text:
        del fields["sanitized_text"]
    kept = [c for c in df.columns if c != text and c not in fields and c != "status"]
    status = F.when(F.size(fields["remaining"]) == 0, "passed").otherwise("review_required")
    return done.select(
        *kept, *(f.alias(name) for name, f in fields.items()), status.alias("status")
    )


def _unrolled(
    df: DataFrame, text: str, max_passes: int, semantic: Callable[[Column], Column] | None
) -> DataFrame:
    """Columns ``_t0 _d0 _t1 _d1 ..``: the text before each look and its hits."""

    def look(work: DataFrame, k: int) -> DataFrame:
        found = find_pii(f"_t{k}")
        if semantic is not None:
            # a text that was clean before is not shown to the plug-in again
            shown = F.col(f"_t{k}")
            if k:
                shown = F.when(F.size(f"_d{k - 1}") > 0, shown).otherwise(F.lit(""))
            work = add_once(work.withColumn("_s", semantic(shown)), _semantic=F.col("_s")).drop("_s")
            found = find_pii(f"_t{k}", F.col("_semantic"))
        if k:
            found = F.when(F.size(f"_d{k - 1}") > 0, found).otherwise(no_detections())
        work = work.withColumn(f"_d{k}", found)
        return work.drop("_semantic")

    work = look(df.withColumn("_t0", F.col(text)), 0)
    for k in range(1, max_passes + 1):
        redacted = F.when(
            F.size(f"_d{k - 1}") > 0, redact_text(f"_t{k - 1}", f"_d{k - 1}")
        ).otherwise(F.col(f"_t{k - 1}"))
        work = look(work.withColumn(f"_t{k}", redacted), k)
    return work


def applied_detections(sanitized: DataFrame, keys: list[str]) -> DataFrame:
    """One row per applied detection with the number of its pass (from 1)."""
    numbered = F.flatten(
        F.transform(
            "detections",
            lambda found, p: F.transform(
                found, lambda d: F.struct((p + 1).alias("pass_no"), d.alias("hit"))
            ),
        )
    )
    return explode_rows(sanitized, keys, numbered).select(
        *keys,
        "d.pass_no",
        "d.hit.detection_type",
        "d.hit.start",
        "d.hit.end",
        "d.hit.confidence",
    )
