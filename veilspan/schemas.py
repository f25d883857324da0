"""Column layouts and fixed vocabularies shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
DETECTION_TYPES = ("tckn", "phone", "email", "person", "address", "face", "signature")
REDACTION_TOKEN = "[REDACTED]"
DEFAULT_MARGIN = 5
DEFAULT_MAX_PASSES = 3
PROVENANCES = ("automatic", "manual")
ACTIONS = ("retain", "remove")
STATUSES = ("passed", "verified_with_human_overrides", "review_required")
# Lowest score kept per raw-prediction label.
SCORE_THRESHOLDS = {
    "person": 0.35,
    "address": 0.30,
    "face": 0.45,
    "signature": 0.25,
    "ocr": 0.0,
}
FACE_IOU = 0.35
SIGNATURE_IOU = 0.50
FACE_TOP_K = 5000
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_IMAGE_PIXELS = 50_000_000
MAX_PDF_PAGES = 100
PDF_DPI = 300
# ----------------------------------------------------------------------------

SPAN = "struct<start:int,end:int>"
TEXT_DETECTION = "struct<start:int,end:int,detection_type:string,confidence:double>"
TEXT_DETECTIONS = f"array<{TEXT_DETECTION}>"
BBOX = "struct<x1:int,y1:int,x2:int,y2:int>"
BOX_DETECTION = f"struct<detection_type:string,bbox:{BBOX},confidence:double>"
BOX_DETECTIONS = f"array<{BOX_DETECTION}>"
LINE_ITEM = f"struct<text:string,bbox:{BBOX},confidence:double>"
LINE_ITEMS = f"array<{LINE_ITEM}>"
RAW_ENTITIES = "array<struct<label:string,start:int,end:int,score:double>>"

OCR_JSON = T.StructType(
    [
        T.StructField("rec_texts", T.ArrayType(T.StringType())),
        T.StructField("rec_scores", T.ArrayType(T.DoubleType())),
        T.StructField("rec_boxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)

MANIFEST_JSON = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        T.StructField(
            "models",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("provider", T.StringType()),
                        T.StructField("license", T.StringType()),
                        T.StructField("target_directory", T.StringType()),
                        T.StructField(
                            "sources",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("repo_id", T.StringType()),
                                        T.StructField("revision", T.StringType()),
                                        T.StructField(
                                            "files",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("path", T.StringType()),
                                                        T.StructField("size", T.LongType()),
                                                        T.StructField("sha256", T.StringType()),
                                                    ]
                                                )
                                            ),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

