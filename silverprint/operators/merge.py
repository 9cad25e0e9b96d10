"""Merges by key. Each returns the new version of a table; writing it is the caller's choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.functions.paths import ext_of
from silverprint.operators.classify import classify_ext, classify_path_server


LATEST_BY = ("computed_at", "created_at", "last_modified")


def one_per_key(incoming: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the latest by the first of ``LATEST_BY`` that is there, then the greatest in all columns.

    The rows are grouped on the key that the merge joins on, so this costs no further shuffle.
    """
    others = [c for c in incoming.columns if c not in key]
    first = [c for c in LATEST_BY if c in others][:1]
    packed = F.struct(*[F.col(c).alias(f"_by_{c}") for c in first], *others)
    return incoming.groupBy(*key).agg(F.max(packed).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], update_cols: list[str]) -> DataFrame:
    """Insert new keys whole; on a known key take over ``update_cols`` only, nulls included. A key given twice counts once."""
    incoming = one_per_key(incoming, key)
    old = existing.select(*key, F.struct(*[c for c in existing.columns if c not in key]).alias("_old"))
    new = incoming.select(*key, F.struct(*[c for c in incoming.columns if c not in key]).alias("_new"))
    is_new, is_known = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def pick(c: str):
        if c not in incoming.columns:
            return F.col(f"_old.{c}")
        if c in update_cols:
            return F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        return F.when(is_known, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))

    merged = old.join(new, key, "full")
    return merged.select(*[F.col(c) if c in key else pick(c).alias(c) for c in existing.columns])


def insert_only(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keep what is known, add unknown keys, each once."""
    incoming = one_per_key(incoming, key)
    return existing.unionByName(incoming.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of known keys are replaced as a whole; a key given twice counts once."""
    incoming = one_per_key(incoming, key)
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def patch(existing: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Overwrite the patched columns of known rows, with null where the patch holds null; one patch a key counts."""
    patches = one_per_key(patches, key)
    columns = [c for c in patches.columns if c not in key]
    packed = patches.select(*key, F.struct(*columns).alias("_patch"))
    joined = existing.join(packed, key, "left")
    return joined.select(
        *[
            F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in existing.columns
        ]
    )


def library_upsert(libraries: DataFrame, roots: DataFrame) -> DataFrame:
    """One library per root path: known roots keep their row, new ones are named after the folder."""
    cleaned = F.regexp_replace("root_path", r"(?<=.)/+$", "")
    fresh = roots.select(
        F.concat(F.lit("lib_"), F.sha1(cleaned)).alias("library_id"),
        F.coalesce("name", F.regexp_extract(cleaned, r"([^/]*)$", 1)).alias("name"),
        cleaned.alias("root_path"),
        "created_at",
    )
    one_per_root = fresh.groupBy("root_path").agg(F.min(F.struct("library_id", "name", "created_at")).alias("_l"))
    return insert_only(libraries, one_per_root.select("_l.library_id", "_l.name", "root_path", "_l.created_at"), ["root_path"])


def media_upsert(media: DataFrame, listing: DataFrame, library_id: str | None = None, rehash_on_change: bool = True) -> DataFrame:
    """Take a listing into the catalog by path.

    New files are classified by their path. Of known files only size and modification time change;
    with ``rehash_on_change`` a change also marks the row for hashing again.
    """
    verdict = classify_path_server(F.col("path"), F.col("filename"))
    library = F.lit(library_id) if library_id is not None else F.col("library_id")
    incoming = listing.withColumn("_v", verdict).select(
        "path",
        F.concat(F.lit("m"), F.sha1("path")).alias("media_id"),
        library.alias("library_id"),
        "filename",
        ext_of(F.col("filename")).alias("ext"),
        classify_ext(ext_of(F.col("filename"))).alias("kind"),
        "size_bytes",
        "last_modified",
        F.col("_v.category").alias("category"),
        F.col("_v.intent").alias("intent"),
        F.col("_v.confidence").alias("category_confidence"),
        F.lit(False).alias("is_hashed"),
    )
    # the old size and time ride along in the same join, to tell changed files from unchanged ones
    known = media.select(
        *[c for c in incoming.columns if c in media.columns],
        F.col("size_bytes").alias("_size"),
        F.col("last_modified").alias("_mtime"),
    )
    merged = upsert(known, incoming, ["path"], ["size_bytes", "last_modified"])
    if rehash_on_change:
        changed = (F.col("_size") != F.col("size_bytes")) | (F.col("_mtime") != F.col("last_modified"))
        merged = merged.withColumn("is_hashed", F.col("is_hashed") & ~F.coalesce(changed, F.lit(False)))
    return merged.drop("_size", "_mtime")


def hash_upsert(hashes: DataFrame, computed: DataFrame) -> DataFrame:
    """New digests by item; the time of the first computation stays."""
    return upsert(hashes, computed, ["media_id"], ["sha256", "dhash_hex"])


def thumbnail_upsert(thumbnails: DataFrame, made: DataFrame) -> DataFrame:
    return upsert(thumbnails, made, ["media_id", "variant"], ["path", "width", "height", "bytes", "created_at"])


def exif_replace(media: DataFrame, exif: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace EXIF rows and overwrite size and capture time of their items, with null when missing.

    Of several records of one item a single one is taken for both tables, see :func:`one_per_key`.
    """
    facts = ("width", "height", "taken_at")
    read = one_per_key(read, ["media_id"])
    rows = read.select(*[c for c in read.columns if c not in facts])
    return patch(media, read.select("media_id", *facts), ["media_id"]), replace_rows(exif, rows, ["media_id"])
