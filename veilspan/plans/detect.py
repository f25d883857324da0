"""Detectors as plug-ins, and the redact-and-verify loop that runs them over images.

A detector is loaded once per Python worker and gets the pixels of one image at a time.
A look at an image paints the rectangles that are known so far and detects what is still
to be seen; both happen in one task, so painted pixels are never stored or moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan import schemas as S
from veilspan.functions.boxes import make_bbox
from veilspan.operators.boxes import redaction_rectangles
from veilspan.operators.passes import first_reports
from veilspan.plans.image import sanitize_pages
from veilspan.session import materialize

#: One detector: pixels (rows, columns, BGR) to ``{"detection_type", "bbox", "confidence"}``
#: with ``bbox`` as ``(x1, y1, x2, y2)``.
Detector = Callable[[np.ndarray], list[dict]]

_NO_BOX = (None, None, None, None)


def pixels_of(row) -> np.ndarray:
    """The pixels of an image row as three channels."""
    pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.n_channels)
    return (np.repeat(pixels, 3, axis=2) if row.n_channels == 1 else pixels[:, :, :3]).copy()


def look_at_images(
    images: DataFrame, keys: Sequence[str], load: Callable[[], Sequence[Detector]], pass_no: int
) -> DataFrame:
    """What the detectors see in ``images`` once their ``rects`` are painted black.

    One row per detection, and one without a type for an image where nothing was seen, so
    that every image that was looked at is known.  A detection outside the image is cut at
    its border; one that is empty then, or has no known type, fails the job, since it would
    hide something from redaction.
    """
    keys = list(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema)
    names = [*keys, "pass_no", "detection_type", "x1", "y1", "x2", "y2", "confidence"]

    def seen(row, detectors: Sequence[Detector]) -> Iterator[tuple]:
        pixels = pixels_of(row)
        for x1, y1, x2, y2 in [] if row.rects is None else row.rects:
            pixels[y1 : y2 + 1, x1 : x2 + 1] = 0
        for detector in detectors:
            for found in detector(pixels):
                x1, y1, x2, y2 = (int(v) for v in found["bbox"])
                box = (max(x1, 0), max(y1, 0), min(x2, row.width), min(y2, row.height))
                if found["detection_type"] not in S.DETECTION_TYPES or box[0] >= box[2] or box[1] >= box[3]:
                    raise ValueError(f"not a detection: {found}")
                yield (found["detection_type"], *box, float(found["confidence"]))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detectors = load()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                rows += [(*key, pass_no, *f) for f in list(seen(row, detectors)) or [(None, *_NO_BOX, None)]]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("x1", "y1", "x2", "y2")})

    return images.select(*keys, "height", "width", "n_channels", "data", "rects").mapInPandas(
        look, f"{fields}, pass_no int, detection_type string, x1 int, y1 int, x2 int, y2 int, confidence double"
    )


def _detections(looks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return looks.filter(F.col("detection_type").isNotNull()).select(
        *keys, "pass_no", "detection_type", make_bbox("x1", "y1", "x2", "y2").alias("bbox"), "confidence"
    )


def _with_rectangles(images: DataFrame, applied: DataFrame, keys: Sequence[str], margin: int) -> DataFrame:
    sizes = images.select(*keys, F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    rects = redaction_rectangles(applied.select(*keys, "bbox").distinct(), sizes, keys, margin)
    corners = F.array("rect.x1", "rect.y1", "rect.x2", "rect.y2")
    return images.join(rects.groupBy(*keys).agg(F.collect_list(corners).alias("rects")), list(keys), "left")


def detect_and_verify(
    images: DataFrame,
    keys: Sequence[str],
    load: Callable[[], Sequence[Detector]],
    max_passes: int = S.DEFAULT_MAX_PASSES,
    margin: int = S.DEFAULT_MARGIN,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, detections and looks of the redact-and-verify loop over ``images``.

    ``images`` is what the image source decodes.  The first look sees the images as they
    are (``pass_no`` 0), the next one all of them with what was found painted; only images
    in which that brought something new are painted and looked at again, ``max_passes``
    times at most.  Outcomes are those of ``sanitize_pages``; ``looks`` has one row per
    image and pass with the number of detections.
    """
    keys = list(keys)
    plain = images.withColumn("rects", F.lit(None).cast("array<array<int>>"))
    looks = [materialize(look_at_images(plain, keys, load, 0))]
    applied = _detections(looks[0], keys)
    again = images
    for number in range(1, max_passes + 1):
        painted = _with_rectangles(again, applied, keys, margin)
        looks.append(materialize(look_at_images(painted, keys, load, number)))
        if number == max_passes:
            break
        new = first_reports(_detections(looks[-1], keys), keys, known=applied)
        changed = materialize(new.select(*keys, "detection_type", "bbox"))
        if changed.isEmpty():
            break
        again = again.join(changed.select(*keys).distinct(), keys, "left_semi")
        applied = applied.select(*keys, "detection_type", "bbox").unionByName(changed)
    every = reduce(DataFrame.unionByName, looks)
    detections = _detections(every, keys)
    outcomes = sanitize_pages(images.select(*keys), detections, keys, max_passes)
    seen = every.groupBy(*keys, "pass_no").agg(F.count("detection_type").alias("found"))
    return outcomes, detections, seen
