"""Time expressions; the session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def member_when(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm")


def exif_timestamp(text: Column) -> Column:
    """EXIF ``YYYY:MM:DD hh:mm:ss`` to a timestamp; text that is no date gives null."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"))


def expires_at(trashed_at: Column, retention_days: int = 30) -> Column:
    return trashed_at + F.make_dt_interval(F.lit(retention_days))


def trash_bucket_name(ts: Column) -> Column:
    """Name of the dated trash folder, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def trash_bucket_time(name: Column) -> Column:
    return F.try_to_timestamp(name, F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)
