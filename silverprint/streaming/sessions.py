"""Photo sessions over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(
    photos: DataFrame,
    group: str = "library_id",
    ts: str = "taken_at",
    gap: str = "12 hours",
    late: str = "1 hour",
    min_photos: int = 3,
) -> DataFrame:
    """Sessions that end after ``gap`` without a photo, for append mode.

    The watermark lets photos come ``late`` and closes sessions, so state stays bounded.
    """
    return _sessions(photos.withWatermark(ts, late), group, ts, gap, min_photos)


def sessions_view(
    closed: DataFrame, photos: DataFrame, group: str = "library_id", ts: str = "taken_at", gap: str = "12 hours", min_photos: int = 3
) -> DataFrame:
    """What a reader sees: the closed sessions, and those still open, from the photos after a group's last closed one."""
    last = closed.groupBy(group).agg(F.max("end_at").alias("_closed"))
    rest = photos.join(last, group, "left").filter(F.col("_closed").isNull() | (F.col(ts) > F.col("_closed")))
    return closed.unionByName(_sessions(rest, group, ts, gap, min_photos))


def _sessions(photos: DataFrame, group: str, ts: str, gap: str, min_photos: int) -> DataFrame:
    return (
        photos.groupBy(F.col(group), F.session_window(ts, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("photos"), F.min(ts).alias("start_at"), F.max(ts).alias("end_at"))
        .filter(F.col("photos") >= min_photos)
        .select(group, "start_at", "end_at", "photos")
    )
