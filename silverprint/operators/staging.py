"""Set algebra on staged ids, group actions and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.operators.keyed import attach_facts


def stage(staged: DataFrame, ids: DataFrame) -> DataFrame:
    return staged.select("media_id").unionByName(ids.select("media_id")).distinct()


def unstage(staged: DataFrame, ids: DataFrame) -> DataFrame:
    return staged.select("media_id").distinct().join(ids.select("media_id"), "media_id", "left_anti")


def clear_staging(staged: DataFrame) -> DataFrame:
    return staged.select("media_id").filter(F.lit(False))


def staged_items(items: DataFrame, staged: DataFrame) -> DataFrame:
    return items.join(staged.select("media_id"), "media_id", "left_semi")


def invert_staging(staged: DataFrame, subset: DataFrame) -> DataFrame:
    """Swap staged and unstaged within ``subset``; everything else stays as it is."""
    marks = staged.select("media_id").distinct().withColumn("s", F.lit(1)).unionByName(
        subset.select("media_id").distinct().withColumn("s", F.lit(2))
    )
    # 1: staged only, 2: in the subset only, 3: both
    return marks.groupBy("media_id").agg(F.sum("s").alias("s")).filter("s in (1, 2)").select("media_id")


def bucket_select(entries: DataFrame, selected: DataFrame, bucket: str | None = None) -> DataFrame:
    """Toggle a bucket (or all entries): select it whole, or clear it when it is selected whole."""
    scope = entries if bucket is None else entries.filter(F.col("bucket") == bucket)
    ids = scope.select("id").distinct()
    picked = selected.select("id").distinct()
    missing = ids.join(picked, "id", "left_anti").agg((F.count(F.lit(1)) > 0).alias("m"))
    select_all = missing.scalar()
    return (
        picked.unionByName(ids)
        .distinct()
        .join(ids.withColumn("_in", F.lit(True)), "id", "left")
        .filter(F.col("_in").isNull() | select_all)
        .select("id")
    )


def resolve_filenames(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Compatibility mode: find the item by file name alone, the last id wins."""
    last = items.groupBy("filename").agg(F.max("media_id").alias("resolved_id"), F.count(F.lit(1)).alias("_n"))
    return attach_facts(rows, last, ["filename"], F.col("_n"), "media_id").drop("_n")


def stage_group_actions(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Keep or trash per member: staged members and all but the largest file are trashed."""
    largest = rows.groupBy("group_id").agg(
        F.min(F.struct((-F.col("size_bytes")).alias("s"), F.col("media_id"))).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    marked = attach_facts(rows, largest, ["group_id"], F.col("_n"), "media_id").join(
        staged.select("media_id").distinct().withColumn("_staged", F.lit(True)), "media_id", "left"
    )
    keep = F.col("_staged").isNull() & (F.col("media_id") == F.col("_b.media_id"))
    return marked.select("group_id", "media_id", "size_bytes", F.when(keep, "keep").otherwise("trash").alias("action"))


def action_totals(actions: DataFrame) -> DataFrame:
    trash = F.col("action") == "trash"
    return actions.groupBy("group_id").agg(
        F.count_if(trash).alias("trashed"),
        F.count_if(~trash).alias("kept"),
        F.coalesce(F.sum(F.when(trash, F.col("size_bytes"))), F.lit(0)).alias("trashed_bytes"),
    )


def apply_group_actions(actions: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged ids after the actions: trash is added, keep is taken out."""
    kept = unstage(staged, actions.filter(F.col("action") == "keep"))
    return stage(kept, actions.filter(F.col("action") == "trash"))


def next_open_group(rows: DataFrame, staged: DataFrame, after: str) -> DataFrame:
    """First group after ``after`` in id order that has an unstaged member."""
    return (
        rows.filter(F.col("group_id") > after)
        .join(staged.select("media_id"), "media_id", "left_anti")
        .agg(F.min("group_id").alias("group_id"))
    )


def remove_items(
    items: DataFrame, groups: DataFrame, members: DataFrame, staged: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, groups, members and staged ids without the removed ones.

    Groups need two survivors; a removed best copy is replaced by the smallest surviving id; bytes
    are counted anew.
    """
    gone = ids.select("media_id")
    left_items = items.join(gone, "media_id", "left_anti")
    survivors = members.join(gone, "media_id", "left_anti")
    sized = survivors.join(items.select("media_id", "size_bytes"), "media_id")
    best = groups.select("group_id", "kind", "best_media_id", "member_count")
    counted = attach_facts(sized, best, ["group_id"], F.col("member_count"), "media_id").groupBy("group_id", "kind").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.min(
            F.struct(
                F.when(F.col("media_id") == F.col("best_media_id"), 0).otherwise(1).alias("o"), "media_id", "size_bytes"
            )
        ).alias("_b"),
    )
    new_groups = counted.filter("member_count > 1").select(
        "group_id",
        "kind",
        "member_count",
        "total_bytes",
        F.col("_b.media_id").alias("best_media_id"),
        (F.col("total_bytes") - F.col("_b.size_bytes")).alias("recoverable_bytes"),
    )
    facts = new_groups.select("group_id", "member_count")
    new_members = attach_facts(survivors, facts, ["group_id"], F.col("member_count"), "media_id").select(*members.columns)
    return left_items, new_groups, new_members, unstage(staged, gone)
