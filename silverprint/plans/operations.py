"""Plans, their effect on the catalog, and undo. No file is moved here: all of it is tables."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.paths import basename, trash_target
from silverprint.functions.text import human_bytes
from silverprint.functions.times import expires_at
from silverprint.plans.naming import new_target, unique_targets
from silverprint.schema import MANIFEST


# Texts of warnings, summaries and the note of a rename.
MISSING_IDS = " requested item(s) no longer exist in the DB"
VANISHED = "Source no longer on disk: "
UNKNOWN_MEDIA = "Unknown media: "
COLLISION, CHOSEN_INSTEAD = "Collision: ", " → "
TRASH_SUMMARY = ("Move ", " file(s) to Trash · ")
RENAME_SUMMARY = ("Rename ", " file(s)")
RENAME_NOTE = "rename"


class Plan(NamedTuple):
    """Planned moves and the warnings found while planning."""

    kind: str
    ops: DataFrame
    warnings: DataFrame


class PlanError(ValueError):
    """A request that must not become a plan."""


def _refuse_empty(requests: DataFrame, kind: str) -> None:
    if requests.isEmpty():
        raise PlanError(f"refusing to plan an empty {kind} operation")


def plan_left_join(requests: DataFrame, items: DataFrame, hashes: DataFrame) -> DataFrame:
    """Requested ids with path, size and digest; unknown ids keep nulls, a missing digest is null."""
    facts = items.select("media_id", "path", "size_bytes").join(hashes.select("media_id", "sha256"), "media_id", "left")
    return requests.select("media_id").distinct().join(facts, "media_id", "left")


def plan_trash(
    requests: DataFrame, items: DataFrame, hashes: DataFrame, listing: DataFrame, operation_id: str, trash_root: str, reason: str
) -> Plan:
    """Moves into the trash for the requested ids; unknown ids and vanished files become warnings."""
    _refuse_empty(requests, "TRASH")
    looked_up = plan_left_join(requests, items, hashes)
    known, present = F.col("path").isNotNull(), F.col("_present").isNotNull()
    # unknown ids have no path to look up; in the join they would all meet in one task
    listed = looked_up.filter(known).join(listing.select("path", F.lit(True).alias("_present")).distinct(), "path", "left")
    ops = listed.filter(present).select(
        "media_id",
        F.col("path").alias("from"),
        trash_target(trash_root, F.lit(operation_id), F.col("path")).alias("to"),
        "size_bytes",
        "sha256",
        F.lit(reason).alias("note"),
    )
    missing = looked_up.agg(F.count_if(~known).alias("n")).filter("n > 0")
    warnings = missing.select(
        F.concat(F.col("n").cast("string"), F.lit(MISSING_IDS)).alias("warning")
    ).unionByName(
        listed.filter(~present).select(F.concat(F.lit(VANISHED), "path").alias("warning"))
    )
    return Plan("TRASH", ops, warnings)


def plan_rename(requests: DataFrame, items: DataFrame, hashes: DataFrame, listing: DataFrame) -> Plan:
    """New names in place, made unique; each collision is reported with the name chosen instead."""
    _refuse_empty(requests, "RENAME")
    requests = requests.select("media_id", "new_name").distinct()
    if not requests.groupBy("media_id").count().filter("count > 1").isEmpty():
        raise PlanError("an item is to be renamed to two names")
    facts = items.select("media_id", "path", "size_bytes").join(hashes.select("media_id", "sha256"), "media_id", "left")
    known = requests.join(facts, "media_id").withColumn("target", new_target(F.col("path"), F.col("new_name")))
    chosen = unique_targets(known.select("media_id", "target"), listing.select("path"))
    ops = known.drop("target").join(chosen, "media_id").select(
        "media_id", F.col("path").alias("from"), F.col("final").alias("to"), "size_bytes", "sha256", F.lit(RENAME_NOTE).alias("note")
    )
    unknown = requests.join(items.select("media_id"), "media_id", "left_anti")
    warnings = unknown.select(F.concat(F.lit(UNKNOWN_MEDIA), "media_id").alias("warning")).unionByName(
        chosen.filter("collided").select(
            F.concat(F.lit(COLLISION), "target", F.lit(CHOSEN_INSTEAD), "final").alias("warning")
        )
    )
    return Plan("RENAME", ops, warnings)


def plan_summary(plan: Plan) -> DataFrame:
    n, total = F.col("n").cast("string"), F.col("total_bytes")
    text = (
        F.concat(F.lit(TRASH_SUMMARY[0]), n, F.lit(TRASH_SUMMARY[1]), human_bytes(total))
        if plan.kind == "TRASH"
        else F.concat(F.lit(RENAME_SUMMARY[0]), n, F.lit(RENAME_SUMMARY[1]))
    )
    return plan.ops.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    ).select(F.lit(plan.kind).alias("kind"), "n", "total_bytes", text.alias("summary"))


def op_safety_check(ops: DataFrame, home: str, kind: str = "TRASH") -> DataFrame:
    """Planned moves that must not run, with the reason; a plan is safe when this is empty."""
    reason = F.when(F.col("from").contains(".."), F.lit("path traversal")).when(
        F.col("from").startswith(home), F.lit("inside the application's own folder")
    )
    if kind == "TRASH":
        reason = reason.when(~F.col("to").startswith(home + "/"), F.lit("target outside the trash"))
    return ops.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def _refuse_unsafe(ops: DataFrame, home: str, kind: str) -> None:
    broken = op_safety_check(ops, home, kind).select("violation", "from").head()
    if broken is not None:
        raise PlanError(f"refusing an unsafe operation: {broken[0]}: {broken[1]}")


def apply_trash(
    items: DataFrame, ops: DataFrame, operation_id: str, at: Column, home: str, retention_days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """The catalog with the trashed items hidden, and the trash entries. An unsafe plan is refused before anything is done."""
    _refuse_unsafe(ops, home, "TRASH")
    entries = ops.select(
        F.concat_ws("_", F.lit("te"), F.lit(operation_id), "media_id").alias("id"),
        F.lit(operation_id).alias("operation_id"),
        "media_id",
        F.col("from").alias("original_path"),
        F.col("to").alias("trash_path"),
        "sha256",
        "size_bytes",
        at.alias("trashed_at"),
        expires_at(at, retention_days).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("restored_at"),
        F.lit(None).cast("timestamp").alias("purged_at"),
    )
    gone = ops.select("media_id", F.lit(True).alias("_gone"))
    hidden = F.coalesce("_gone", F.col("is_hidden"))
    return items.join(gone, "media_id", "left").withColumn("is_hidden", hidden).select(*items.columns), entries


def apply_rename(items: DataFrame, ops: DataFrame, home: str) -> DataFrame:
    """The catalog with new paths. An unsafe plan is refused before anything is done."""
    _refuse_unsafe(ops, home, "RENAME")
    moved = ops.select("media_id", F.col("to").alias("_to"))
    new_path = F.coalesce("_to", "path")
    return items.join(moved, "media_id", "left").withColumns({"path": new_path, "filename": basename(new_path)}).select(*items.columns)


def manifest_json(ops: DataFrame) -> DataFrame:
    """One JSON object per move, the size as text. A manifest is kept as rows, not as one long text."""
    return ops.select(
        "media_id",
        F.to_json(
            F.struct(
                F.col("media_id").alias("mediaId"), "from", "to", "sha256", F.col("size_bytes").cast("string").alias("sizeBytes")
            ),
            {"ignoreNullFields": "false"},
        ).alias("entry"),
    )


def manifest_parse(operations: DataFrame) -> DataFrame:
    """Manifest text (an array of moves, or one move) to rows."""
    text = F.when(F.col("manifest").startswith("["), F.col("manifest")).otherwise(
        F.concat(F.lit("["), F.col("manifest"), F.lit("]"))
    )
    return operations.select(F.col("id").alias("operation_id"), F.explode(F.from_json(text, MANIFEST)).alias("_e")).select(
        "operation_id",
        F.col("_e.mediaId").alias("media_id"),
        F.col("_e.from").alias("from"),
        F.col("_e.to").alias("to"),
        F.col("_e.sha256").alias("sha256"),
        F.col("_e.sizeBytes").cast("long").alias("size_bytes"),
    )


class Undo(NamedTuple):
    """Catalog after the undo, outcome per move, and the changed trash entries."""

    items: DataFrame
    outcome: DataFrame
    entries: DataFrame


def check_undo(operation: DataFrame) -> DataFrame:
    """Why an operation cannot be undone; empty when it can."""
    reason = (
        F.when(F.col("status") == "UNDONE", F.lit("already undone"))
        .when(F.col("manifest").isNull(), F.lit("no manifest"))
    )
    return operation.withColumn("refusal", reason).filter(F.col("refusal").isNotNull())


def undo_outcome(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Each move of a manifest as restored, gone from the trash, or blocked by a file in its place."""
    paths = listing.select("path").distinct()
    in_trash = paths.select(F.col("path").alias("to"), F.lit(True).alias("_in_trash"))
    in_place = paths.select(F.col("path").alias("from"), F.lit(True).alias("_in_place"))
    joined = manifest.join(in_trash, "to", "left").join(in_place, "from", "left")
    return joined.select(
        *manifest.columns,
        F.when(F.col("_in_trash").isNull(), F.lit("gone"))
        .when(F.col("_in_place").isNotNull(), F.lit("occupied"))
        .otherwise(F.lit("restored"))
        .alias("outcome"),
    )


def apply_undo(
    operation: DataFrame, manifest: DataFrame, items: DataFrame, entries: DataFrame, listing: DataFrame, at: Column, kind: str
) -> Undo:
    """Bring items back to their old paths where the file is in the trash and the place is free."""
    if operation.isEmpty():
        raise PlanError("unknown operation")
    refused = check_undo(operation).select("refusal").head()
    if refused is not None:
        raise PlanError(f"operation cannot be undone: {refused['refusal']}")
    outcome = undo_outcome(manifest, listing)
    back = outcome.filter("outcome = 'restored'").select("media_id", F.col("from").alias("_from"))
    path = F.coalesce("_from", "path")
    changes = {"path": path, "filename": basename(path)}
    if kind == "TRASH":
        changes["is_hidden"] = F.col("is_hidden") & F.col("_from").isNull()
    restored_items = items.join(back, "media_id", "left").withColumns(changes).select(*items.columns)
    marked = entries.join(back, "media_id", "left").withColumn(
        "restored_at", F.when(F.col("_from").isNotNull(), at).otherwise(F.col("restored_at"))
    )
    return Undo(restored_items, outcome, marked.select(*entries.columns))


def undo_summary(outcome: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "restored"
    return outcome.agg(F.count_if(ok).alias("restored"), F.count_if(~ok).alias("failed"))


def op_status(results: DataFrame) -> DataFrame:
    """COMPLETED without failures (also when empty), FAILED without successes, else PARTIAL."""
    return (
        results.groupBy("operation_id")
        .agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
        .select(
            "operation_id",
            "succeeded",
            "failed",
            F.when(F.col("failed") == 0, "COMPLETED").when(F.col("succeeded") == 0, "FAILED").otherwise("PARTIAL").alias("status"),
        )
    )


def restore_targets(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Where trash entries go back to: the old path, or a numbered one when it is taken."""
    wanted = entries.select(F.col("id").alias("media_id"), F.col("relative_path").alias("target"))
    return unique_targets(wanted, listing).select(F.col("media_id").alias("id"), "target", "final", "collided")


def verify_copy(source: DataFrame, copy: DataFrame, with_hash: bool = False) -> DataFrame:
    """Files whose copy is missing, has another size or, on request, another digest."""
    columns = ["size_bytes", "sha256"] if with_hash else ["size_bytes"]
    there = copy.select("relative_path", *[F.col(c).alias(f"copy_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = source.select("relative_path", *columns).join(there, "relative_path", "left")
    problem = F.when(F.col("_there").isNull(), F.lit("missing")).when(
        F.col("size_bytes") != F.col("copy_size_bytes"), F.lit("size differs")
    )
    if with_hash:
        problem = problem.when(~F.col("sha256").eqNullSafe(F.col("copy_sha256")), F.lit("content differs"))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_there")


def trash_expired(entries: DataFrame, now: Column) -> DataFrame:
    """Entries past their date and still there, to be shown to the user; nothing is purged."""
    return entries.filter(
        (F.col("expires_at") <= now) & F.col("restored_at").isNull() & F.col("purged_at").isNull()
    )


def trash_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def trash_buckets(entries: DataFrame) -> DataFrame:
    """Entries and bytes per dated bucket; the row without a bucket is the total."""
    return entries.rollup("bucket").agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def trash_browse_order(entries: DataFrame) -> DataFrame:
    """Newest bucket first, then by path."""
    return entries.withColumn("id", F.concat_ws("::", "bucket", "relative_path")).orderBy(
        F.col("bucket").desc(), "relative_path"
    )


# Fixed value: entries that get a preview.
PREVIEWS = 30


def trash_preview_todo(entries: DataFrame) -> DataFrame:
    """Which of the first entries can be shown as pictures."""
    first = trash_browse_order(entries).limit(PREVIEWS)
    return first.filter(F.col("filename").rlike(r"(?i)\.(jpe?g|png|webp|gif|bmp|avif)$"))


def op_log_inconsistent(operations: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Operations left executing, and finished ones with moves whose target is not there."""
    stuck = operations.filter(F.col("status") == "EXECUTING").select(F.col("id").alias("operation_id"), F.lit("left executing").alias("problem"))
    done = operations.filter(F.col("status").isin("COMPLETED", "PARTIAL")).select(F.col("id").alias("operation_id"))
    lost = (
        manifest.join(done, "operation_id", "left_semi")
        .join(listing.select(F.col("path").alias("to")), "to", "left_anti")
        .groupBy("operation_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("operation_id", F.concat(F.col("n").cast("string"), F.lit(" moved file(s) not found")).alias("problem"))
    )
    return stuck.unionByName(lost)


def rename_template(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Names ``date-what-seq.ext`` from capture date and the first known of event, place and subject.

    ``facts`` may hold ``event``, ``location`` and ``subject`` per item; the sequence counts the
    items of one directory with the same date and text by time.
    """
    from silverprint.operators.ranking import rank_within

    joined = items.select("media_id", "path", "ext", "taken_at", "last_modified").join(facts, "media_id", "left")
    at = F.coalesce("taken_at", "last_modified")
    what = F.lower(F.regexp_replace(F.coalesce("event", "location", "subject", F.lit("photo")), r"[^\p{L}\p{Nd}]+", "_"))
    named = joined.select(
        "media_id",
        "ext",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.date_format(at, "yyyy-MM-dd").alias("day"),
        what.alias("what"),
        at.alias("at"),
    )
    numbered = rank_within(named, ["dir", "day", "what"], [F.col("at"), F.col("media_id")], "seq")
    return numbered.select(
        "media_id",
        F.concat("day", F.lit("-"), "what", F.lit("-"), F.lpad(F.col("seq").cast("string"), 3, "0"), "ext").alias("new_name"),
    )


# Columns a saved album query may refer to.
ALBUM_COLUMNS = (
    "category",
    "intent",
    "kind",
    "ext",
    "filename",
    "size_bytes",
    "width",
    "height",
    "taken_at",
    "last_modified",
    "is_favorite",
    "is_hidden",
    "library_id",
)


#: Words that a saved predicate may hold besides the columns.
ALBUM_WORDS = ("and", "or", "not", "in", "between", "like", "is", "null", "true", "false", "timestamp", "date")


def smart_album(items: DataFrame, query: str) -> DataFrame:
    """Members of a saved predicate: allowed columns, literals, comparisons and ``ALBUM_WORDS``; no functions.

    Any other name is refused before Spark sees the text, and so are quoted names and comments.
    """
    bare = re.sub(r"'[^'\\]*'", "''", query)
    names = re.findall(r"[^\W\d]\w*", bare)
    unknown = [n for n in names if n.lower() not in ALBUM_WORDS and n not in ALBUM_COLUMNS]
    if unknown or re.search(r"[`\"\\;{}\[\]@$]|--|/\*", bare) or re.search(rf"\b({'|'.join(ALBUM_COLUMNS)})\s*\(", bare):
        raise PlanError(f"not a predicate of an album: {query}")
    visible = items.select("media_id", *[c for c in ALBUM_COLUMNS if c in items.columns])
    # as a column: a filter would look through the projection for names it does not find
    return visible.select("media_id", F.expr(query).alias("_member")).filter("_member").select("media_id")
