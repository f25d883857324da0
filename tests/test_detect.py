"""Detector plug-ins over real images: the loop, and what is looked at again."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.plans.detect import detect_and_verify, look_at_images
from veilspan.sources.files import read_images

KEYS = ["path"]


def png(path, pixels):
    """A grey image file without any library."""
    height, width = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", header) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def squares(*levels):
    """An image of bright squares on black; each has its own place and level."""
    pixels = np.zeros((60, 200))
    for i, level in enumerate(levels):
        pixels[20:40, 30 * i + 10 : 30 * i + 20] = level
    return pixels


def loader():
    """A detector that reports the brightest square only, so others are seen once it is gone."""

    def load():
        def brightest(pixels):
            grey = pixels[:, :, 0]
            if grey.max() < 50:
                return []
            y, x = np.nonzero(grey == grey.max())
            return [{"detection_type": "face", "bbox": (x.min(), y.min(), x.max() + 1, y.max() + 1), "confidence": float(grey.max()) / 255}]

        return [brightest]

    return load


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    for name, levels in {"clean": (), "one": (200,), "two": (200, 150), "three": (200, 150, 100), "four": (250, 200, 150, 100)}.items():
        png(folder / f"{name}.png", squares(*levels))
    decoded = read_images(spark, str(folder)).filter("valid")
    name = F.regexp_extract("image.origin", r"(\w+)\.png$", 1).alias("path")
    return decoded.select(name, "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_loop(spark, images, limit):
    outcomes, detections, looks = detect_and_verify(images, KEYS, loader(), max_passes=limit, margin=2)
    hidden = {"clean": 0, "one": 1, "two": 2, "three": 3, "four": 4}
    got = {r.path: (r.redaction_passes, r.applied_count, r.remaining_count, r.passed) for r in outcomes.collect()}
    # one square is found by the first look, one more by each that follows a redaction
    want = {}
    for name, n in hidden.items():
        passes = min(max(n, 1), limit)
        left = int(n > passes)
        want[name] = (passes, min(n, passes), left, not left)
    assert got == want
    # only images in which the pass before found something new are looked at again
    counted = {(r.pass_no): r["count"] for r in looks.groupBy("pass_no").count().collect()}
    assert counted == {0: 5} | {k: sum(1 for n in hidden.values() if k == 1 or n > k - 1) for k in range(1, limit + 1)}
    assert detections.filter("pass_no = 0").count() == 4


def test_refused_detections(spark, images):
    plain = images.withColumn("rects", F.lit(None).cast("array<array<int>>"))
    for found in ({"detection_type": "cat", "bbox": (0, 0, 5, 5), "confidence": 1.0}, {"detection_type": "face", "bbox": (300, 0, 310, 5), "confidence": 1.0}):
        with pytest.raises(Exception, match="not a detection"):
            look_at_images(plain, KEYS, lambda found=found: [lambda pixels: [found]], 0).collect()
    beyond = look_at_images(plain, KEYS, lambda: [lambda pixels: [{"detection_type": "face", "bbox": (-5, -5, 900, 7), "confidence": 1}]], 0)
    assert {(r.x1, r.y1, r.x2, r.y2) for r in beyond.collect()} == {(0, 0, 200, 7)}


def test_models_are_loaded_once_a_worker(spark, images, tmp_path):
    load, path = loader(), str(tmp_path / "loads")

    def counted():
        with open(path, "a") as log:
            log.write("x")
        return load()

    plain = images.withColumn("rects", F.lit(None).cast("array<array<int>>")).coalesce(1)
    assert look_at_images(plain, KEYS, counted, 0).count() == 5
    assert (tmp_path / "loads").read_text() == "x"


def test_no_images(spark, images):
    outcomes, detections, looks = detect_and_verify(images.limit(0), KEYS, loader())
    assert outcomes.count() == detections.count() == looks.count() == 0
