"""Page image statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "origin string, height int, width int, channels int, is_thermal boolean, quality double, status string"
TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.string())


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pages (origin, height, width, nChannels, data) from an image folder."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def gray_levels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of a row-major BGR(A) or grey buffer."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0].astype(np.float64)
    b, g, r = (px[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.float64)


def _features(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        sizes = (batch.column(k).to_pylist() for k in (0, 1, 2, 3))
        rows = []
        for (origin, height, width, channels), data in zip(zip(*sizes, strict=True), batch.column(4), strict=True):
            gray = gray_levels(data.as_buffer(), height, width, channels)
            white = float((gray > 128).mean())
            rows.append((origin, height, width, channels, bool(gray.mean() > 180 and gray.std() < 60), max(0.0, min(1.0, 1.0 - abs(white - 0.7) * 2)), "ok"))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names)


def image_features(images: DataFrame) -> DataFrame:
    """Size, thermal-paper flag and quality of each page; one small row per image leaves Python."""
    ok = (F.col("height") > 0) & (F.col("width") > 0)
    return images.filter(ok).select("origin", "height", "width", "nChannels", "data").mapInArrow(_features, SCHEMA)
