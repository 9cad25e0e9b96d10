"""Pixels and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverprint.functions.imaging import image_features

# Fixed value: images above this many bytes are not decoded (50 MiB).
DECODE_LIMIT = 50 * 1024 * 1024


def image_pixels(spark: SparkSession, root: str, max_bytes: int = DECODE_LIMIT, glob: str = "*") -> DataFrame:
    """Decoded images below ``root``: path, height, width, channels and BGR bytes.

    The image source cannot filter by file size, so larger files are dropped by a join with the
    listing before their pixels go any further.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    sizes = (
        spark.read.format("binaryFile").options(**options).load(root).filter(F.col("length") <= max_bytes).select("path")
    )
    images = spark.read.format("image").option("dropInvalid", True).options(**options).load(root).select("image.*")
    strip = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    small = sizes.select(strip.alias("path"))
    return images.withColumn("path", F.regexp_replace("origin", "^file:(//)?(?=/)", "")).join(small, "path", "left_semi")


def with_features(images: DataFrame) -> DataFrame:
    """Replace the pixels by hash, sharpness, brightness and colour spread, from one decoding."""
    features = image_features(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))
    keep = [c for c in images.columns if c not in ("data", "mode", "origin", "nChannels")]
    return images.select(*keep, features.alias("_f")).select(*keep, "_f.*")
