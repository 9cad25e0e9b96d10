"""Path expressions on ``/``-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thumbnail variants and the longest side of each.
THUMB_VARIANTS = {"thumb256": 256, "thumb1024": 1024}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def extname(name: Column) -> Column:
    """Extension with its dot, case kept; a leading dot does not start an extension."""
    return F.regexp_extract(basename(name), r"^.+?(\.[^.]*)$", 1)


def ext_of(name: Column) -> Column:
    """Lower-case extension from the last dot on, even when the dot comes first."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def trash_target(root: str, operation: Column, path: Column) -> Column:
    slug = F.substring(F.sha1(path), 1, 16)
    return F.concat_ws("/", F.lit(root), operation, slug, basename(path))


def thumb_path(sha: Column, variant: Column) -> Column:
    return F.concat(
        F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.lit("."), variant, F.lit(".webp")
    )


def fit_inside(width: Column, height: Column, side: Column) -> Column:
    """Size scaled to fit a square of ``side`` without enlarging, at least one pixel each way."""
    scale = F.least(F.lit(1.0), side / F.greatest(width, height))

    def scaled(x: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(x * scale + F.lit(0.5)).cast("int"))

    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))
