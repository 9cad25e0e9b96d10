"""Cleanup summary, diagnostics and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.text import fmt_bytes, plural
from silverprint.operators.dedup import BEST_COPY, BEST_NEAR
from silverprint.operators.keyed import single
from silverprint.operators.ranking import QuantileRule
from silverprint.operators.selection import quantile_members
from silverprint.operators.views import is_tiny
from silverprint.schema import LARGE_VIDEO_BYTES, NO_DHASH, PAPER_CATEGORIES

# Buckets of the cleanup view with label, text and confidence.
BUCKETS = {
    "dups": ("Exact & visual duplicates", "Same photo saved multiple times. We picked the best copy of each.", 0.98),
    "ws": ("WhatsApp & messenger media", "Forwarded memes, low-res copies, and chat thumbnails.", 0.85),
    "shots": ("Screenshots", "Captured for a moment in time — most are older than what they referenced.", 0.92),
    "blur": ("Documents & receipts", "Ephemeral by intent — receipts, parking spots, IDs, QR codes.", 0.8),
    "burst": ("Near duplicates", "{n} near-duplicate cluster(s) — resizes, recompresses, slight crops.", 0.85),
    "large": ("Large videos (>500 MB)", "Long clips you may want to archive or compress.", 0.7),
}

# Share of items taken by the quality suggestions.
QUALITY_RULES = {
    "blurry": ("quality_score", 0.05, "low"),
    "dark": ("brightness", 0.05, "low"),
    "blank": ("color_variance", 0.05, "low"),
    "blown": ("brightness", 0.02, "high"),
}

# Icon, priority, title and text of each suggestion. {n} counts items, {groups} counts
# groups, {bytes} is their size; {s}, {y} and {gs} are the plural endings that go with the counts.
SUGGESTIONS = {
    "dups-exact": (
        "save",
        1.0,
        "Remove {n} exact-duplicate cop{y}",
        "{groups} duplicate group{gs} found by SHA-256 · recover {bytes}",
    ),
    "dups-near": (
        "burst",
        2.0,
        "Keep best frame of {groups} near-duplicate cluster{gs}",
        "{n} extra copies found by perceptual hash · recover {bytes}",
    ),
    "blurry": (
        "blur",
        3.0,
        "Review {n} least-sharp photo{s}",
        "Bottom 5% by Laplacian variance · {bytes} · likely blurry or out of focus",
    ),
    "dark": (
        "dark",
        4.0,
        "Review {n} darkest photo{s}",
        "Bottom 5% by mean luma · {bytes} · likely underexposed or accidental pocket shots",
    ),
    "blank": (
        "blank",
        4.5,
        "Review {n} likely blank or accidental photo{s}",
        "Lowest 5% RGB variance · {bytes} · walls, lens-covered, near-monochrome — usually safe to delete",
    ),
    "blown": ("dark", 5.0, "Review {n} overexposed photo{s}", "Top 2% brightness · {bytes} · mostly white frames"),
    "screenshots": (
        "shot",
        6.0,
        "{n} screenshot{s} detected",
        "Matched filename pattern (Screenshot_*, /Screenshots/) · {bytes}",
    ),
    "messenger": (
        "wa",
        7.0,
        "{n} WhatsApp/messenger file{s}",
        "Matched IMG-YYYYMMDD-WA* or /WhatsApp/Media/ path · {bytes}",
    ),
    "transactional": (
        "doc",
        8.0,
        "{n} ephemeral document{s}",
        "Receipts, QR codes, parking spots, IDs · {bytes}",
    ),
    "tiny": (
        "tiny",
        9.0,
        "{n} low-resolution image{s}",
        "≤800px on the long edge · {bytes} · typically shared/compressed copies",
    ),
    "bigvideo": (
        "video",
        10.0,
        "{n} large video{s} (>500 MB each)",
        "Often safe to archive or compress · {bytes} total",
    ),
}
SAFE_SUGGESTIONS = ("dups-exact", "dups-near")


def _is_large_video() -> Column:
    return (F.col("kind") == "VIDEO") & (F.col("size_bytes") > LARGE_VIDEO_BYTES)


def _is_paper() -> Column:
    return F.col("category").isin(*PAPER_CATEGORIES)


def _bytes(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("size_bytes"))), F.lit(0)).cast("long")


def _group_totals(groups: DataFrame, prefix: str) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias(f"{prefix}_groups"),
        F.coalesce(F.sum("member_count"), F.lit(0)).alias(f"{prefix}_files"),
        F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias(f"{prefix}_bytes"),
    )


def _with_group_totals(row: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """Put the totals of both group tables next to a single row."""
    return row.select(
        "*", single(_group_totals(exact, "exact")).alias("_e"), single(_group_totals(near, "near")).alias("_n")
    ).select(*row.columns, "_e.*", "_n.*")


def _totals(items: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    shots, chat = F.col("category") == "SCREENSHOT", F.col("category") == "WHATSAPP_FORWARD"
    one_pass = items.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("photos_used"),
        *[
            expr.alias(name)
            for prefix, condition in (("ws", chat), ("shots", shots), ("blur", _is_paper()), ("large", _is_large_video()))
            for name, expr in ((f"{prefix}_n", F.count_if(condition)), (f"{prefix}_b", _bytes(condition)))
        ],
    )
    return _with_group_totals(one_pass, exact, near)


def cleanup_summary(items: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """Totals of the library and what could be reclaimed."""
    return _totals(items, exact, near).select(
        "total_scanned",
        "photos_used",
        (F.col("exact_bytes") + F.col("near_bytes") + F.col("ws_b")).alias("reclaim"),
    )


def cleanup_buckets(items: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """The six buckets; near duplicates count in two of them."""
    values = {
        "dups": (F.col("exact_files") + F.col("near_files"), F.col("exact_bytes") + F.col("near_bytes")),
        "ws": (F.col("ws_n"), F.col("ws_b")),
        "shots": (F.col("shots_n"), F.col("shots_b")),
        "blur": (F.col("blur_n"), F.col("blur_b")),
        "burst": (F.col("near_files"), F.col("near_bytes")),
        "large": (F.col("large_n"), F.col("large_b")),
    }
    rows = [
        F.struct(
            F.lit(id_).alias("id"),
            F.lit(label).alias("label"),
            values[id_][0].cast("long").alias("count"),
            values[id_][1].cast("long").alias("size"),
            F.replace(F.lit(text), F.lit("{n}"), F.col("near_groups").cast("string")).alias("desc"),
            F.lit(confidence).alias("confidence"),
            F.lit("review").alias("recommended"),
        )
        for id_, (label, text, confidence) in BUCKETS.items()
    ]
    return _totals(items, exact, near).select(F.inline(F.array(*rows)))


def populated_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.filter("count > 0")


def storage_share(buckets: DataFrame) -> DataFrame:
    """Share of each bucket with items in the bytes of all six buckets."""
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).scalar()
    return populated_buckets(buckets).select(
        "id", "size", F.when(total > 0, F.col("size") / total).otherwise(F.lit(0.0)).alias("share")
    )


def diagnostics(items: DataFrame, exact: DataFrame, near: DataFrame, bright_q: float = 0.02) -> DataFrame:
    """One row saying what was examined and what was found."""
    hashed = F.col("sha256").isNotNull() & (F.col("sha256") != "")
    with_dhash = F.col("dhash_hex").isNotNull() & (F.col("dhash_hex") != NO_DHASH)

    def taken(column: str, q: float) -> Column:
        n = F.count_if(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf")))
        return F.least(n, F.greatest(F.lit(3), F.ceil(n.cast("double") * q))).cast("long")

    faces = F.greatest(F.coalesce(F.size("faces"), F.lit(0)), F.lit(0))
    facts = items.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("kind") == "IMAGE").alias("total_images"),
        F.count_if(F.col("kind") == "VIDEO").alias("total_videos"),
        F.count_if(hashed).alias("hashed"),
        F.count_if(with_dhash).alias("with_dhash"),
        F.count_if(F.col("quality_score").isNotNull()).alias("with_quality"),
        taken("quality_score", 0.05).alias("blurry_count"),
        taken("brightness", 0.05).alias("dark_count"),
        taken("brightness", bright_q).alias("bright_count"),
        F.count_if(F.col("category") == "SCREENSHOT").alias("screenshots"),
        F.count_if(F.col("category") == "WHATSAPP_FORWARD").alias("whatsapp"),
        F.count_if(_is_paper()).alias("transactional"),
        F.count_if(F.size("embedding") > 0).alias("embedded"),
        F.count_if(faces > 0).alias("with_faces"),
        F.coalesce(F.sum(faces), F.lit(0)).alias("total_faces"),
    )
    return _with_group_totals(facts, exact, near).drop("exact_bytes", "near_bytes")


def classified_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def classified_map(items: DataFrame) -> DataFrame:
    """Counts per category as one map; there are only as many entries as categories."""
    return classified_counts(items).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("classified")
    )


def suggestion_members(items: DataFrame, exact_members: DataFrame, near_members: DataFrame) -> DataFrame:
    """``(suggestion_id, media_id, bytes)``: every item of every suggestion.

    The member tables name the best copy by their reason text; it is the one that is kept.
    """
    sized = items.select("media_id", "size_bytes")
    spare = (
        exact_members.filter(F.col("reason") != BEST_COPY)
        .select(F.lit("dups-exact").alias("suggestion_id"), "media_id")
        .unionByName(
            near_members.filter(F.col("reason") != BEST_NEAR).select(
                F.lit("dups-near").alias("suggestion_id"), "media_id"
            )
        )
    )
    duplicates = spare.join(sized, "media_id").select("suggestion_id", "media_id", F.col("size_bytes").alias("bytes"))

    rules = [
        QuantileRule(name, column, q, side, where="kind = 'IMAGE'") for name, (column, q, side) in QUALITY_RULES.items()
    ]
    weak = quantile_members(items, rules, carry=("size_bytes",)).select(
        F.col("rule").alias("suggestion_id"), "media_id", F.col("size_bytes").alias("bytes")
    )

    marks = F.array_compact(
        F.array(
            F.when(F.col("category") == "SCREENSHOT", "screenshots"),
            F.when(F.col("category") == "WHATSAPP_FORWARD", "messenger"),
            F.when(_is_paper(), "transactional"),
            F.when(is_tiny(), "tiny"),
            F.when(_is_large_video(), "bigvideo"),
        )
    )
    by_rule = items.select(F.explode(marks).alias("suggestion_id"), "media_id", F.col("size_bytes").alias("bytes"))
    return duplicates.unionByName(weak).unionByName(by_rule)


def _by_suggestion(position: int) -> Column:
    chain = F
    for id_, entry in SUGGESTIONS.items():
        chain = chain.when(F.col("suggestion_id") == id_, F.lit(entry[position]))
    return chain.otherwise(F.lit(None))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def suggestions(members: DataFrame, exact_groups: DataFrame, near_groups: DataFrame, with_items: bool = False) -> DataFrame:
    """At most eleven rows with counts, bytes, texts and priority, most urgent first.

    The member table is the full answer; ``with_items`` adds the ids as one array per row, which is
    only for libraries small enough to be shown whole.
    """
    collected = [F.array_sort(F.collect_list("media_id")).alias("item_ids")] if with_items else []
    counted = members.groupBy("suggestion_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes"), *collected
    )
    groups = F.when(
        F.col("suggestion_id") == "dups-exact", exact_groups.agg(F.count(F.lit(1))).scalar()
    ).otherwise(near_groups.agg(F.count(F.lit(1))).scalar())
    shown = counted.filter((F.col("suggestion_id") != "tiny") | (F.col("count") >= 3)).withColumn("groups", groups)
    values = {
        "n": F.col("count").cast("string"),
        "s": plural(F.col("count"), "", "s"),
        "y": plural(F.col("count"), "y", "ies"),
        "groups": F.col("groups").cast("string"),
        "gs": plural(F.col("groups"), "", "s"),
        "bytes": fmt_bytes(F.col("bytes")),
    }
    return shown.select(
        F.col("suggestion_id").alias("id"),
        _by_suggestion(0).alias("icon"),
        _filled(_by_suggestion(2), values).alias("title"),
        _filled(_by_suggestion(3), values).alias("body"),
        "count",
        "bytes",
        _by_suggestion(1).alias("priority"),
        *(["item_ids"] if with_items else []),
    ).orderBy("priority")


def suggestion_totals(visible: DataFrame) -> DataFrame:
    """Files and bytes over the visible suggestions; a file in two of them counts twice."""
    return visible.agg(
        F.count(F.lit(1)).alias("suggestions"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def suggestion_totals_distinct(members: DataFrame) -> DataFrame:
    """The same with every file counted once."""
    once = members.groupBy("media_id").agg(F.max("bytes").alias("bytes"))
    return once.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def visible_suggestions(rows: DataFrame, dismissed: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(dismissed.select(F.col("id").alias(id_col)), id_col, "left_anti")


def safe_suggestions(members: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Items of the two duplicate suggestions, unless dismissed: safe to stage in one go."""
    kept = members.filter(F.col("suggestion_id").isin(*SAFE_SUGGESTIONS))
    return visible_suggestions(kept, dismissed, "suggestion_id").select("media_id").distinct()
