"""Work that is still open: anti joins of items against result tables, and batch numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.functions.paths import THUMB_VARIANTS, fit_inside, thumb_path
from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import global_rank


def _capped(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy("media_id").limit(limit)


def hash_todo(items: DataFrame, hashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Items without digests, and items whose file has changed since (``is_hashed`` is false)."""
    done = hashes.select(F.col("media_id").alias("_done"))
    fresh = F.coalesce("is_hashed", F.lit(True)) if "is_hashed" in items.columns else F.lit(True)
    return _capped(items.join(done, (F.col("media_id") == F.col("_done")) & fresh, "left_anti"), limit)


def exif_todo(items: DataFrame, exif: DataFrame, limit: int | None = None) -> DataFrame:
    images = items.filter(F.col("kind") == "IMAGE")
    return _capped(images.join(exif.select("media_id"), "media_id", "left_anti"), limit)


def thumb_todo(items: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Hashed items without any thumbnail."""
    hashed = items.filter(F.col("sha256").isNotNull())
    return hashed.join(thumbnails.select("media_id").distinct(), "media_id", "left_anti")


def item_hash_join(items: DataFrame, hashes: DataFrame, library: str | None = None) -> DataFrame:
    rows = items if library is None else items.filter(F.col("library_id") == library)
    return rows.join(hashes, "media_id")


def thumbnail_plan(items: DataFrame, present: DataFrame) -> DataFrame:
    """Thumbnails to make: hashed images by variant, unless the content already has that variant.

    Present thumbnails are looked up once per distinct content, so a file copied very often costs
    one row in that join.
    """
    variants = F.array(
        *[F.struct(F.lit(name).alias("variant"), F.lit(side).alias("side")) for name, side in THUMB_VARIANTS.items()]
    )
    images = items.filter((F.col("kind") == "IMAGE") & F.col("sha256").isNotNull())
    contents = images.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    missing = contents.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in THUMB_VARIANTS]))).join(
        present.select("sha256", "variant").distinct(), ["sha256", "variant"], "left_anti"
    )
    rows = images.select("media_id", "sha256", "width", "height", F.explode(variants).alias("_v")).select(
        "media_id", "sha256", "width", "height", "_v.variant", "_v.side"
    )
    return (
        attach_facts(rows, missing, ["sha256", "variant"], F.col("copies"), "media_id")
        .withColumn("_fit", fit_inside(F.col("width"), F.col("height"), F.col("side")))
        .select(
            F.concat_ws("_", F.lit("tn"), "media_id", "variant").alias("id"),
            "media_id",
            "variant",
            thumb_path(F.col("sha256"), F.col("variant")).alias("path"),
            F.col("_fit.width").alias("width"),
            F.col("_fit.height").alias("height"),
        )
    )


# Items per batch of each kind of work.
BATCH_SIZES = {"hash": 50, "exif": 25, "thumb": 20}


def work_batches(todo: DataFrame, size: int) -> DataFrame:
    """Number the open items by id and cut them into batches of ``size``."""
    ranked = global_rank(todo.select("media_id"), [F.col("media_id")], "_n")
    return ranked.select("media_id", F.floor((F.col("_n") - 1) / size).alias("batch"))


def job_list(jobs: DataFrame, status: str | None = None, type_: str | None = None, limit: int = 100) -> DataFrame:
    """Newest jobs first, optionally of one status and type."""
    rows = jobs
    if status:
        rows = rows.filter(F.col("status") == status)
    if type_:
        rows = rows.filter(F.col("type") == type_)
    return rows.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))


def job_next(jobs: DataFrame, now, types: list[str] | None = None, limit: int = 1) -> DataFrame:
    """Due pending jobs by priority, then by time: a report of what would run next."""
    due = jobs.filter((F.col("status") == "PENDING") & (F.col("scheduled_at") <= now))
    if types:
        due = due.filter(F.col("type").isin(types))
    return due.orderBy(F.col("priority").desc(), F.col("scheduled_at").asc(), F.col("id")).limit(limit)


def model_run_summary(patches: DataFrame) -> DataFrame:
    """What a model run produced: embeddings, faces and items that failed."""
    return patches.agg(
        F.count(F.lit(1)).alias("analysed"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.coalesce(F.sum(F.when(F.size("faces") > 0, F.size("faces"))), F.lit(0)).cast("long").alias("faces"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
