"""Recognition results as JSON: one document per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.boxes import bbox_is_valid, confidence_is_valid, make_bbox
from veilspan.functions.text import strip
from veilspan.operators.detections import add_once
from veilspan.schemas import LINE_ITEMS, OCR_JSON


def parse_ocr_results(df: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Page rows with ``items``, and the rows that cannot be used with ``error``.

    The arrays of texts, scores and boxes may sit at the top or under ``res``.
    Blank texts are skipped; other rows of a bad page are not used either.
    """
    nested = T.StructType(
        [
            *OCR_JSON.fields,
            T.StructField("res", OCR_JSON),
            T.StructField("_bad", T.StringType()),
        ]
    )
    root = add_once(
        df, _root=F.from_json(json, nested, {"columnNameOfCorruptRecord": "_bad"})
    )
    parsed = add_once(
        root,
        _p=F.when(F.col("_root.res").isNotNull(), F.col("_root.res")).otherwise(
            F.struct("_root.rec_texts", "_root.rec_scores", "_root.rec_boxes")
        ),
    )
    sizes = [
        F.greatest(F.size(f"_p.{name}"), F.lit(0)) for name in OCR_JSON.fieldNames()
    ]
    zipped = F.arrays_zip(
        F.col("_p.rec_texts").alias("text"),
        F.col("_p.rec_scores").alias("score"),
        F.col("_p.rec_boxes").alias("box"),
    )
    used = F.filter(
        F.transform(
            F.coalesce(zipped, F.array().cast("array<struct<text:string,score:double,box:array<double>>>")),
            lambda z: F.struct(
                strip(z["text"]).alias("text"),
                z["score"].alias("score"),
                z["box"].alias("box"),
            ),
        ),
        lambda z: z["text"] != "",
    )
    staged = add_once(parsed, _used=used)
    items = F.transform(
        "_used",
        lambda z: F.struct(
            z["text"].alias("text"),
            make_bbox(*(F.get(z["box"], i) for i in range(4))).alias("bbox"),
            z["score"].alias("confidence"),
        ),
    ).cast(LINE_ITEMS)
    error = (
        F.when(F.col("_root").isNull() | F.col("_root._bad").isNotNull(), "not valid JSON")
        .when((sizes[0] != sizes[1]) | (sizes[0] != sizes[2]), "arrays differ in length")
        .when(F.exists("_used", lambda z: F.coalesce(F.size(z["box"]), F.lit(0)) != 4), "bad box shape")
        .when(F.exists("items", lambda i: ~bbox_is_valid(i["bbox"])), "invalid box")
        .when(
            F.exists("items", lambda i: ~confidence_is_valid(i["confidence"])),
            "invalid confidence",
        )
    )
    checked = add_once(add_once(staged, items=items), error=error)
    keep = [c for c in df.columns if c != json]
    good = checked.filter(F.col("error").isNull()).select(*keep, "items")
    bad = checked.filter(F.col("error").isNotNull()).select(*keep, "error")
    return good, bad
