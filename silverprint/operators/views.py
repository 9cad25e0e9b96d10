"""View rows, sort orders, month groups and page queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.text import natural_key
from silverprint.functions.times import iso_date
from silverprint.schema import LARGE_VIDEO_BYTES, PAPER_CATEGORIES

# Thresholds of the quality flags and the side of a tiny image.
BLURRY_BELOW = 30.0
DARK_BELOW = 0.18
OVEREXPOSED_ABOVE = 0.92
BLANK_BELOW = 200.0
TINY_SIDE = 800


def view_category(kind: Column, category: Column) -> Column:
    return (
        F.when(kind == "VIDEO", "video")
        .when(category == "SCREENSHOT", "screenshot")
        .when(category == "MEME", "meme")
        .when(category.isin(*PAPER_CATEGORIES), "document")
        .when(category == "WHATSAPP_FORWARD", "whatsapp")
        .otherwise("photo")
    )


def photo_view(items: DataFrame) -> DataFrame:
    """Items as grid rows: coarse category, short id, size, date and neutral quality values."""
    return items.select(
        F.col("media_id").alias("id"),
        F.substring("sha256", 1, 16).alias("uid"),
        view_category(F.col("kind"), F.col("category")).alias("cat"),
        "filename",
        F.col("size_bytes").alias("size"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        iso_date(F.col("last_modified")).alias("date"),
        F.lit(0.7).alias("quality"),
        F.lit(0.6).alias("aesthetic"),
        F.lit(False).alias("blurry"),
        F.lit(False).alias("dark"),
        F.lit(False).alias("burst"),
    )


def category_filter(view: DataFrame, cat: str) -> DataFrame:
    return view if cat == "all" else view.filter(F.col("cat") == cat)


def quality_flags(items: DataFrame) -> DataFrame:
    return items.select(
        "media_id",
        (F.col("quality_score") < BLURRY_BELOW).alias("blurry"),
        (F.col("brightness") < DARK_BELOW).alias("dark"),
        (F.col("brightness") > OVEREXPOSED_ABOVE).alias("overexposed"),
        (F.col("color_variance") < BLANK_BELOW).alias("blank"),
    )


def is_tiny() -> Column:
    return (F.col("kind") == "IMAGE") & (F.col("width") <= TINY_SIDE) & (F.col("height") <= TINY_SIDE)


def tiny_images(items: DataFrame, at_least: int = 3) -> DataFrame:
    """Small images, or nothing when there are fewer than ``at_least`` of them."""
    enough = items.filter(is_tiny()).agg((F.count(F.lit(1)) >= at_least).alias("enough"))
    return items.filter(is_tiny() & enough.scalar())


def large_videos(items: DataFrame) -> DataFrame:
    return items.filter((F.col("kind") == "VIDEO") & (F.col("size_bytes") > LARGE_VIDEO_BYTES))


def model_targets(items: DataFrame) -> DataFrame:
    """Items that go to model analysis."""
    return items.filter(F.col("kind") == "IMAGE")


SORT_KEYS = ("date-desc", "date-asc", "size-desc", "size-asc", "name-asc")


def sort_order(key: str, date: str = "last_modified", size: str = "size_bytes", id_col: str = "media_id") -> list[Column]:
    """Order columns of a sort key, the id last so that equal rows have a fixed order."""
    orders = {
        "date-desc": F.col(date).desc(),
        "date-asc": F.col(date).asc(),
        "size-desc": F.col(size).desc(),
        "size-asc": F.col(size).asc(),
        "name-asc": natural_key(F.col("filename")).asc(),
    }
    return [orders[key], F.col(id_col).asc()]


def sort_items(items: DataFrame, key: str) -> DataFrame:
    return items.orderBy(*sort_order(key))


def month_groups(items: DataFrame) -> DataFrame:
    """Items per calendar month with the newest date, newest month first."""
    month = F.date_trunc("month", "last_modified")
    return (
        items.groupBy(month.alias("_month"))
        .agg(F.count(F.lit(1)).alias("count"), F.max("last_modified").alias("newest"))
        .select(F.date_format("_month", "MMMM yyyy").alias("month"), "count", "newest")
        .orderBy(F.col("newest").desc())
    )


def category_counts(view: DataFrame) -> DataFrame:
    """Rows per category and their total under ``all``."""
    return view.rollup("cat").agg(F.count(F.lit(1)).alias("count")).select(
        F.coalesce("cat", F.lit("all")).alias("cat"), "count"
    )


def keyset_page(items: DataFrame, after: str | None, size: int = 200, id_col: str = "media_id") -> DataFrame:
    """The next page by id: a filter and a top-k, never an offset."""
    rows = items if after is None else items.filter(F.col(id_col) > after)
    return rows.orderBy(id_col).limit(size)


def focus_subset(items: DataFrame, ids: DataFrame, staged: DataFrame, key: str = "size-desc") -> DataFrame:
    """Known items of an id list in sort order, with their staged mark."""
    marks = staged.select("media_id").distinct().withColumn("_staged", F.lit(True))
    return (
        items.join(ids.select("media_id").distinct(), "media_id", "left_semi")
        .join(marks, "media_id", "left")
        .withColumn("is_staged", F.coalesce("_staged", F.lit(False)))
        .drop("_staged")
        .orderBy(*sort_order(key))
    )


def focus_totals(subset: DataFrame) -> DataFrame:
    return subset.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if("is_staged").alias("staged"),
        F.coalesce(F.sum(F.when(F.col("is_staged"), F.col("size_bytes"))), F.lit(0)).alias("staged_bytes"),
    )


def scan_summary(items: DataFrame, groups: DataFrame) -> DataFrame:
    counts = items.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("kind") == "IMAGE").alias("images"),
        F.count_if(F.col("kind") == "VIDEO").alias("videos"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )
    return counts.withColumn("groups", groups.agg(F.count(F.lit(1))).scalar())


def library_list(libraries: DataFrame) -> DataFrame:
    """Libraries newest first, 64-bit totals as text."""
    return libraries.select(
        "library_id", "name", "root_path", "item_count", F.col("total_bytes").cast("string").alias("total_bytes"), "created_at"
    ).orderBy(F.col("created_at").desc(), "library_id")


def library_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("size_bytes").alias("total_bytes"), F.max("last_modified").alias("last_seen")
    )


def thumbnail_lookup(thumbnails: DataFrame, media_id: str, variant: str = "thumb256") -> DataFrame:
    return thumbnails.filter((F.col("media_id") == media_id) & (F.col("variant") == variant)).limit(1)


def hash_distinct_check(items: DataFrame, like: str) -> DataFrame:
    """Distinct digests and rows, split by a name pattern."""
    return items.agg(
        F.countDistinct("sha256").alias("distinct_sha"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("filename").like(like)).alias("like_rows"),
        F.count_if(~F.col("filename").like(like)).alias("unlike_rows"),
    )
