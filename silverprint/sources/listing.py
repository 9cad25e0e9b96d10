"""File listings and content digests."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.functions.paths import basename, extname
from silverprint.operators.classify import classify_ext
from silverprint.sources.tree import file_system, read_tree

# Directory names and file-name starts that a scan passes over. The application's own
# folders come on top, as the caller's ``app_dirs``.
IGNORED_DIRS = (
    ".git",
    ".svn",
    ".hg",
    "node_modules",
    ".next",
    ".cache",
    ".thumbnails",
    ".trash",
    "@eaDir",
    "@Recycle",
    ".Trashes",
    ".Spotlight-V100",
    ".fseventsd",
    "System Volume Information",
    "$RECYCLE.BIN",
)
IGNORED_PREFIXES = (".", "~$")

#: Bytes of a file that are in memory at once while it is digested.
CHUNK_BYTES = 1 << 24


def media_listing(files: DataFrame, rules: str = "server", ignore: bool = True, app_dirs: tuple[str, ...] = (), root: str = "") -> DataFrame:
    """Media files among ``files (path, size_bytes, last_modified)`` with name, extension and kind.

    With ``ignore`` the ignored directories (below ``root``) and file-name starts are passed over.
    """
    name = basename(F.col("path"))
    rows = files.withColumns({"filename": name, "ext": extname(name) if rules == "server" else F.regexp_extract(name, r"(\.[^.]*)$", 1)})
    rows = rows.withColumn("kind", classify_ext(F.col("ext"), rules)).filter(F.col("kind") != "UNKNOWN")
    if not ignore:
        return rows
    below = F.expr(f"substring(path, {len(root) + 1})")
    parents = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    ignored = F.array(*[F.lit(d) for d in (*IGNORED_DIRS, *app_dirs)])
    rows = rows.filter(~F.arrays_overlap(parents, ignored))
    for prefix in IGNORED_PREFIXES:
        rows = rows.filter(~F.col("filename").startswith(prefix))
    return rows


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` without reading their content.

    Spark leaves out names that start with ``_`` or ``.``; :func:`list_tree` lists those as well.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("last_modified"),
        )
    )


def list_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """All files below ``root`` as the tasks find them; ignored and linked directories are not entered."""
    return read_tree(spark, root.rstrip("/"), ignored).filter("error IS NULL").drop("error")


def unreadable(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Folders below ``root`` that could not be read, with the reason."""
    return read_tree(spark, root.rstrip("/"), ignored).filter("error IS NOT NULL").select("path", "error")


def scan_files(spark: SparkSession, root: str, app_dirs: tuple[str, ...] = (), spark_listing: bool = False) -> DataFrame:
    """Media files of a library folder by the server's rules.

    ``spark_listing`` lets Spark's file source list the tree: names that start with ``_`` are then
    missed and linked directories are followed.
    """
    root = root.rstrip("/")
    files = list_files(spark, root) if spark_listing else list_tree(spark, root, (*IGNORED_DIRS, *app_dirs))
    return media_listing(files, "server", True, app_dirs, root)


def scan_files_unfiltered(spark: SparkSession, root: str, spark_listing: bool = False) -> DataFrame:
    """Media files by the browser's rules: extensions only, nothing is ignored."""
    files = list_files(spark, root) if spark_listing else list_tree(spark, root.rstrip("/"))
    return media_listing(files, "browser", False)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        found = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            try:
                system, inner = file_system(path)
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            except OSError:  # gone or not readable
                found.append(None)
        yield batch.assign(sha256=found)


def with_digests(files: DataFrame) -> DataFrame:
    """``files`` with the SHA-256 of the content at ``path``, null where it cannot be read. Files of any size are read in chunks."""
    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())])
    return files.mapInPandas(_digests, schema)


def content_hash(spark: SparkSession, root: str, glob: str = "*", ignored: tuple[str, ...] = ()) -> DataFrame:
    """``path`` and SHA-256 of every file below ``root`` whose name matches ``glob``."""
    pattern = fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z")
    paths = list_tree(spark, root, ignored).select("path").filter(basename(F.col("path")).rlike(f"^{pattern}$"))
    # files are dealt to all tasks, whatever folders they lie in
    return with_digests(paths.repartition(F.xxhash64("path")))
