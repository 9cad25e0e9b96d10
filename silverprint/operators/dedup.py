"""Exact and near duplicates, and the copy to keep of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.hashing import hamming
from silverprint.functions.text import group_label
from silverprint.functions.times import member_when
from silverprint.functions.vectors import l2_normalize
from silverprint.operators.components import connected_components
from silverprint.operators.hamming_pairs import (
    HAMMING_LIMIT,
    RANK_WINDOW,
    hash_groups,
    near_banded_pairs,
    near_candidates,
    near_window_links,
    rank_by_hash,
)
from silverprint.operators.keyed import attach_facts
from silverprint.operators.vector_pairs import SIMILAR_COSINE, eps_of_cosine, vector_components
from silverprint.workspace import materialise

# Weights of the keep score and the path words it looks for.
BYTE_WEIGHT = 0.0001
CAMERA_BONUS = 1_000_000.0
COPY_MALUS = 500_000.0
CAMERA_WORDS = "(?i)DCIM|Camera"
COPY_WORDS = "(?i)WhatsApp|Sent|Copy"


# Reasons of members and notes of the duplicate view.
BEST_COPY, OTHER_COPY, BEST_NEAR, NEAR_DISTANCE = "best candidate", "duplicate of best", "best of cluster", "hamming="
BEST_SIMILAR, OTHER_SIMILAR = "best of group", "similar to best"
NOTE_BEST, NOTE_EXACT, NOTE_NEAR = "Best candidate", "Byte-identical", "Near duplicate"


def keep_score(path: Column, width: Column, height: Column, size: Column) -> Column:
    """Pixels plus a little for bytes, more for camera folders, less for copies."""
    pixels = F.coalesce(width.cast("double") * height.cast("double"), F.lit(0.0))
    camera = F.when(path.rlike(CAMERA_WORDS), F.lit(CAMERA_BONUS)).otherwise(F.lit(0.0))
    copied = F.when(path.rlike(COPY_WORDS), F.lit(COPY_MALUS)).otherwise(F.lit(0.0))
    return pixels + size.cast("double") * BYTE_WEIGHT + camera - copied


def _item_score() -> Column:
    return keep_score(F.col("path"), F.col("width"), F.col("height"), F.col("size_bytes"))


def _group_facts(rows: DataFrame, key: str, ties: list[Column]) -> DataFrame:
    """Size, bytes and best member per key: all mergeable aggregates, so partial ones run first."""
    best = F.min(F.struct((-_item_score()).alias("s"), *ties, F.col("media_id"), F.col("size_bytes")))
    return (
        rows.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.sum("size_bytes").alias("total_bytes"),
            best.alias("_best"),
        )
        .withColumn("best_media_id", F.col("_best.media_id"))
        .withColumn("recoverable_bytes", F.col("total_bytes") - F.col("_best.size_bytes"))
        .drop("_best")
    )


_GROUP_COLUMNS = ["group_id", "kind", "member_count", "total_bytes", "best_media_id", "recoverable_bytes"]


def pick_best(rows: DataFrame, group: str, near: bool = False) -> DataFrame:
    """Member with the highest keep score per group.

    Exact ties fall to the larger file, then the smaller id; near ties to hash order, then the id.
    """
    ties = [F.col("dhash_hex").alias("t")] if near else [(-F.col("size_bytes")).alias("t")]
    best = F.min(F.struct((-_item_score()).alias("s"), *ties, F.col("media_id")))
    return rows.groupBy(group).agg(best.alias("_b")).select(
        group, F.col("_b.media_id").alias("best_media_id"), (-F.col("_b.s")).alias("score")
    )


def _exact_facts(items: DataFrame, library: str | None, members_scope: str) -> DataFrame:
    rows = items.filter(F.col("sha256").isNotNull() & (F.col("sha256") != ""))
    if library is not None and members_scope == "library":
        rows = rows.filter(F.col("library_id") == library)
    ties = [(-F.col("size_bytes")).alias("t")]
    if library is None or members_scope == "library":
        return _group_facts(rows, "sha256", ties).filter("member_count > 1")
    # groups are found in one library but list the copies of all of them
    found = (
        rows.groupBy("sha256").agg(F.count_if(F.col("library_id") == library).alias("n")).filter("n > 1")
    )
    return _group_facts(rows, "sha256", ties).join(found.select("sha256"), "sha256", "left_semi")


def exact_dup_groups(
    items: DataFrame, library: str | None = None, members_scope: str = "library", prefix: str = "dg_", digits: int = 64
) -> DataFrame:
    """Groups of byte-identical items with their best copy and the bytes the others take."""
    return _exact_facts(items, library, members_scope).select(
        F.concat(F.lit(prefix), F.substring("sha256", 1, digits)).alias("group_id"),
        F.lit("EXACT").alias("kind"),
        *_GROUP_COLUMNS[2:],
    )


def exact_dup_members(
    items: DataFrame, library: str | None = None, members_scope: str = "library", hot_rows: int | None = None
) -> DataFrame:
    """One row per copy in an exact group."""
    facts = _exact_facts(items, library, members_scope).select("sha256", "member_count", "best_media_id")
    rows = items.select("sha256", "media_id", "library_id").filter(F.col("sha256").isNotNull() & (F.col("sha256") != ""))
    if library is not None and members_scope == "library":
        rows = rows.filter(F.col("library_id") == library)
    joined = attach_facts(rows, facts, ["sha256"], F.col("member_count"), "media_id", hot_rows)
    is_best = F.col("media_id") == F.col("best_media_id")
    return joined.select(
        F.concat(F.lit("dg_"), F.col("sha256")).alias("group_id"),
        "media_id",
        F.lit(1.0).alias("score"),
        F.when(is_best, BEST_COPY).otherwise(OTHER_COPY).alias("reason"),
    )


def dup_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"),
        F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias("bytes_recoverable"),
    )


_SIMILAR_COLUMNS = ["media_id", "path", "width", "height", "size_bytes"]
# What near deduplication carries along; everything else stays in the catalog.
_NEAR_COLUMNS = ["media_id", "sha256", "dhash", "dhash_hex", "path", "width", "height", "size_bytes"]


def near_tagged(items: DataFrame, hashes: DataFrame, library: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Candidates whose hash is in ``hashes (dhash, component, copies)``, with its component."""
    candidates = near_candidates(items, library).select(*_NEAR_COLUMNS)
    return attach_facts(candidates, hashes, ["dhash"], F.col("copies"), "media_id", hot_rows).drop("copies")


def _near_tagged(
    items: DataFrame, library: str | None, limit: int, window: int, mode: str, hot_rows: int | None = None
) -> DataFrame:
    """Near-duplicate candidates with the component they belong to; lone ones are left out."""
    candidates = near_candidates(items, library).select(*_NEAR_COLUMNS)
    if mode == "window":
        ranked = rank_by_hash(candidates)
        links = near_window_links(ranked, limit, window)
        labels = connected_components(links, "rank_a", "rank_b", hot_rows)
        tagged = ranked.join(labels.withColumnRenamed("node", "rank"), "rank").drop("rank")
    elif mode == "banded":
        groups = materialise(hash_groups(candidates), "hash_groups")
        labels = connected_components(
            near_banded_pairs(groups, limit, links_only=True), "dhash_a", "dhash_b", hot_rows
        )
        facts = (
            groups.join(labels.withColumnRenamed("node", "dhash"), "dhash", "left")
            .filter(F.col("component").isNotNull() | (F.col("sha_lo") != F.col("sha_hi")))
            .select("dhash", F.coalesce("component", "dhash").alias("component"), "copies")
        )
        tagged = near_tagged(items, facts, library, hot_rows)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return materialise(tagged, "near_tagged")


def near_dedup(
    items: DataFrame,
    library: str | None = None,
    limit: int = HAMMING_LIMIT,
    window: int = RANK_WINDOW,
    mode: str = "window",
    hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Groups and members of near duplicates.

    ``window`` compares neighbours in hash order only; ``banded`` finds every pair in range.
    A group is numbered by the smallest rank (or hash) in it.
    """
    return near_outputs(_near_tagged(items, library, limit, window, mode, hot_rows), hot_rows)


def near_outputs(tagged: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and members of the components in a stored table of tagged candidates."""
    facts = _group_facts(tagged, "component", [F.col("dhash_hex").alias("t")])
    group_id = F.concat_ws("_", F.lit("ng"), F.col("component").cast("string"), F.right("best_media_id", F.lit(8)))
    facts = facts.withColumn("group_id", group_id)
    groups = facts.select("group_id", F.lit("NEAR").alias("kind"), *_GROUP_COLUMNS[2:])

    best = tagged.select(F.col("media_id").alias("best_media_id"), F.col("dhash").alias("best_dhash"))
    with_best = facts.join(best, "best_media_id").select(
        "component", "group_id", "best_media_id", "best_dhash", "member_count"
    )
    joined = attach_facts(tagged, with_best, ["component"], F.col("member_count"), "media_id", hot_rows)
    d = hamming(F.col("dhash"), F.col("best_dhash"))
    members = joined.select(
        "group_id",
        "media_id",
        (1 - d / 64).alias("score"),
        F.when(F.col("media_id") == F.col("best_media_id"), F.lit(BEST_NEAR))
        .otherwise(F.concat(F.lit(NEAR_DISTANCE), d.cast("string")))
        .alias("reason"),
    )
    return groups, members


def similar_groups(items: DataFrame, cosine: float = SIMILAR_COSINE) -> tuple[DataFrame, DataFrame]:
    """Groups and members of pictures that look alike: links of ``cosine`` or more between embeddings, chains included.

    The best of a burst is the one to keep. Items without embedding are in no group; a group is named by its smallest id.
    """
    unit = items.filter(F.size("embedding") > 0).select("media_id", l2_normalize(F.col("embedding")).alias("vec"))
    labels = vector_components(unit, "media_id", "vec", eps_of_cosine(cosine) + 1e-9)
    tagged = materialise(items.select(*_SIMILAR_COLUMNS).join(labels, "media_id"), "similar_tagged")
    facts = _group_facts(tagged, "component", [(-F.col("size_bytes")).alias("t")]).withColumn(
        "group_id", F.concat_ws("_", F.lit("sg"), F.col("component").cast("string"))
    )
    groups = facts.select("group_id", F.lit("SIMILAR").alias("kind"), *_GROUP_COLUMNS[2:])
    joined = attach_facts(tagged, facts.select("component", "group_id", "best_media_id", "member_count"), ["component"], F.col("member_count"), "media_id")
    best = F.col("media_id") == F.col("best_media_id")
    return groups, joined.select("group_id", "media_id", F.when(best, BEST_SIMILAR).otherwise(OTHER_SIMILAR).alias("reason"))


def dedup_recompute(items: DataFrame, library: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact, then near: all groups and all members."""
    near_groups, near_members = near_dedup(items, library)
    return (
        exact_dup_groups(items, library).unionByName(near_groups),
        exact_dup_members(items, library).unionByName(near_members),
    )


def all_dup_groups(exact: DataFrame, near: DataFrame) -> DataFrame:
    return exact.unionByName(near)


def member_rows(groups: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Group facts and item facts side by side, one row per known member."""
    by_member = members.join(
        items.select("media_id", "filename", "sha256", "size_bytes", "width", "height", "last_modified"), "media_id"
    )
    facts = groups.select("group_id", "kind", "best_media_id", "member_count")
    return attach_facts(by_member, facts, ["group_id"], F.col("member_count"), "media_id")


def dup_member_view(groups: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Members as shown in the duplicate view; the label comes from the smallest member id."""
    rows = member_rows(groups, members, items)
    first = rows.groupBy("group_id").agg(
        F.min(F.struct("media_id", "filename")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    rows = attach_facts(rows, first, ["group_id"], F.col("_n"), "media_id")
    exact = F.col("kind") == "EXACT"
    return rows.select(
        "group_id",
        "media_id",
        F.substring("sha256", 1, 16).alias("uid"),
        "filename",
        F.col("size_bytes").alias("size"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        member_when(F.col("last_modified")).alias("when"),
        F.when(F.col("media_id") == F.col("best_media_id"), NOTE_BEST)
        .when(exact, NOTE_EXACT)
        .otherwise(NOTE_NEAR)
        .alias("note"),
        F.when(exact, F.lit(1.0)).otherwise(F.lit(0.9)).alias("confidence"),
        group_label(F.col("_first.filename")).alias("label"),
    )


def dup_recommended_by_size(rows: DataFrame) -> DataFrame:
    """Largest file of each group, smallest id on ties: what the duplicate view preselects."""
    pick = F.min(F.struct((-F.col("size_bytes")).alias("s"), F.col("media_id")))
    return rows.groupBy("group_id").agg(pick.alias("_b")).select(
        "group_id", F.col("_b.media_id").alias("recommended_id"), (-F.col("_b.s")).alias("size_bytes")
    )


def dup_list_totals(rows: DataFrame) -> DataFrame:
    """Copies and bytes per group, and over all groups in the row without a group id."""
    return rows.rollup("group_id").agg(
        F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def keep_score_full(
    items: DataFrame, exif: DataFrame, quality: DataFrame, exif_bonus: float = 250_000.0, aesthetic_weight: float = 100_000.0, depth_malus: float = 1_000.0
) -> DataFrame:
    """Keep score with EXIF presence, aesthetic score and path depth added."""
    with_exif = items.join(exif.select("media_id", F.lit(True).alias("has_exif")), "media_id", "left").join(
        quality.select("media_id", "aesthetic"), "media_id", "left"
    )
    depth = F.size(F.split("path", "/")) - 1
    score = (
        _item_score()
        + F.when(F.col("has_exif"), F.lit(exif_bonus)).otherwise(F.lit(0.0))
        + F.coalesce(F.col("aesthetic"), F.lit(0.0)) * aesthetic_weight
        - depth * depth_malus
    )
    return with_exif.select(*items.columns, score.alias("score"))


def keep_with_confidence(scored: DataFrame, members: DataFrame) -> DataFrame:
    """Best member per group and how clearly it wins: lead over the runner-up, as a share of the score."""
    rows = members.select("group_id", "media_id").join(scored.select("media_id", "score", "size_bytes"), "media_id")
    entry = F.struct((-F.col("score")).alias("s"), (-F.col("size_bytes")).alias("z"), F.col("media_id"))
    best = rows.groupBy("group_id").agg(F.min(entry).alias("_b"), F.count(F.lit(1)).alias("_n"))
    others = attach_facts(rows, best, ["group_id"], F.col("_n"), "media_id").filter(
        F.col("media_id") != F.col("_b.media_id")
    )
    second = others.groupBy("group_id").agg(F.max("score").alias("second"))
    lead = (-F.col("_b.s") - F.col("second")) / F.greatest(F.abs(F.col("_b.s")), F.lit(1.0))
    return best.join(second, "group_id").select(
        "group_id",
        F.col("_b.media_id").alias("best_media_id"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), lead)).alias("confidence"),
    )
