"""Black fill of decoded images, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[np.ndarray, list, int], np.ndarray]


def fill_rectangles(
    images: DataFrame,
    rectangles: DataFrame,
    keys: Sequence[str],
    margin: int = 0,
    transform: Transform | None = None,
) -> DataFrame:
    """Overwrite rectangles with black pixels: ``keys, height, width, data, error``.

    ``images`` has ``height, width, n_channels, data`` as the image source
    yields them (BGR bytes, top row first); ``rectangles`` has ``rect`` as
    computed by ``redaction_rectangles``, its last row and column included.
    The output has three channels.  The rectangles of one image are gathered
    with it after copies are removed, since an image is filled in one piece.

    A rectangle that is null could not be placed in its image.  Such an image is
    held back: its ``data`` is null and ``error`` says why.

    ``transform(pixels, rectangles, margin)`` may change the filled pixels.
    """
    keys = list(keys)
    per_image = (
        rectangles.select(*keys, "rect")
        .distinct()
        .groupBy(*keys)
        .agg(
            F.collect_list(
                F.when(F.col("rect").isNotNull(), F.array("rect.x1", "rect.y1", "rect.x2", "rect.y2"))
            ).alias("rects"),
            F.bool_or(F.col("rect").isNull()).alias("unplaced"),
        )
    )
    joined = images.join(per_image, keys, "left").select(
        *keys, "height", "width", "n_channels", "data", "rects", "unplaced"
    )
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in keys)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled, errors = [], []
            for row in batch.itertuples(index=False):
                if row.unplaced is True:
                    filled.append(None)
                    errors.append("a rectangle does not lie in the image")
                    continue
                errors.append(None)
                pixels = np.frombuffer(row.data, dtype=np.uint8).reshape(
                    row.height, row.width, row.n_channels
                )
                if row.n_channels == 1:
                    pixels = np.repeat(pixels, 3, axis=2)
                pixels = pixels[:, :, :3].copy()
                rects = [] if row.rects is None else [list(r) for r in row.rects]
                for x1, y1, x2, y2 in rects:
                    pixels[y1 : y2 + 1, x1 : x2 + 1] = 0
                if transform is not None:
                    pixels = transform(pixels, rects, margin)
                filled.append(pixels.tobytes())
            out = batch[keys + ["height", "width"]].copy()
            out["data"] = filled
            out["error"] = errors
            yield out

    return joined.mapInPandas(fill, f"{key_fields}, height int, width int, data binary, error string")
