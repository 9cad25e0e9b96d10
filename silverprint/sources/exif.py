"""EXIF tag records (JSON text) to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.functions.times import exif_timestamp

# Tag names and the columns they fill.
TAGS = {
    "make": ("Make", T.StringType()),
    "model": ("Model", T.StringType()),
    "lens": ("LensModel", T.StringType()),
    "iso": ("ISO", T.IntegerType()),
    "f_number": ("FNumber", T.DoubleType()),
    "exposure_time": ("ExposureTime", T.DoubleType()),
    "focal_length": ("FocalLength", T.DoubleType()),
    "orientation": ("Orientation", T.IntegerType()),
    "gps_lat": ("GPSLatitude", T.DoubleType()),
    "gps_lon": ("GPSLongitude", T.DoubleType()),
    "gps_alt": ("GPSAltitude", T.DoubleType()),
}
SIZE_TAGS = {"width": ("ImageWidth", T.IntegerType()), "height": ("ImageHeight", T.IntegerType())}


def exif_normalize(records: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """Typed EXIF columns, image size and capture time; a bad date gives null."""
    wanted = {**TAGS, **SIZE_TAGS, "_taken": ("DateTimeOriginal", T.StringType())}
    schema = T.StructType([T.StructField(tag, type_) for tag, type_ in wanted.values()])
    parsed = records.withColumn("_t", F.from_json(F.col(json_col), schema))
    return parsed.select(
        "media_id",
        *[F.col(f"_t.{tag}").alias(name) for name, (tag, _) in {**TAGS, **SIZE_TAGS}.items()],
        exif_timestamp(F.col("_t.DateTimeOriginal")).alias("taken_at"),
        F.col(json_col).alias("raw_json"),
    )
