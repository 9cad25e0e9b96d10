"""Streaming queries: each runs a stream over the tables to its end and reads the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.operators.classify import classify_ext
from silverprint.parity.records import TREE_SQL
from silverprint.parity.registry import query, with_
from silverprint.parity.tables import Tables
from silverprint.sources import listing
from silverprint.streaming import ingest, levels, sessions
from silverprint.workspace import new_table_path


def _stream(t: Tables, name: str) -> DataFrame:
    """A driver table as a stream of its files; a table is one file or a folder of files.

    The pattern matches just the table's own name: a plain path would have to be a folder.
    """
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.dir}/{name}.parque[t]")


def _listing_stream(t: Tables) -> DataFrame:
    from silverprint.parity.records import DIRS, ENDINGS, PREFIXES
    from silverprint.parity.tables import _pick

    d = F.col("doc_id")
    return _stream(t, "documents").select(
        F.concat(
            F.lit("/lib/"), "source", F.lit("/"), _pick(DIRS, d % 8), _pick(PREFIXES, F.col("n_chars") % 4), F.lit("file"), d.cast("string"), _pick(ENDINGS, d % 6)
        ).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.timestamp_millis(F.lit(1704067200000) + d * 5400000).alias("last_modified"),
        F.sha2("text", 256).alias("sha256"),
    )


def _finish(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    log = new_table_path(t.spark, "stream")
    ingest.append_batches(stream, log, new_table_path(t.spark, "checkpoint"), mode, availableNow=True).awaitTermination()
    return t.spark.read.schema(stream.schema.add("batch", "long")).parquet(log)


@query(
    "stream_ingest",
    with_(TREE_SQL) + f"""SELECT p.path, CASE WHEN lower(ext) IN ('.mp4', '.mts') THEN 'VIDEO' ELSE 'IMAGE' END AS kind, size_bytes,
      CASE WHEN regexp_matches(path, '(?i)[\\\\/](DCIM|Camera|100[A-Z]+)[\\\\/]') THEN 'PHOTO' ELSE 'OTHER' END AS category FROM parted p
    WHERE ext <> '.txt' AND NOT list_has_any(dirs, {list(listing.IGNORED_DIRS)}) AND NOT starts_with(filename, '.') AND NOT starts_with(filename, '~$')""",
)
def _(t: Tables):
    log = new_table_path(t.spark, "ingest")
    ingest.stream_ingest(_listing_stream(t), log, new_table_path(t.spark, "checkpoint"), availableNow=True).awaitTermination()
    return ingest.catalog_view(t.spark.read.parquet(log)).select("path", "kind", "size_bytes", "category")


@query(
    "stream_exact_dups",
    """SELECT sha256(text) AS sha256, count(*) AS copies, CAST(sum(n_chars) AS BIGINT) AS total_bytes, min('m' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS first_id
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(t: Tables):
    items = _stream(t, "documents").select(
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id"),
        F.col("n_chars").alias("size_bytes"),
    )
    return ingest.latest_updates(_finish(t, ingest.stream_exact_dups(items), "update"))


@query(
    "stream_exact_dups_levelled",
    """SELECT sha256(text) AS sha256, count(*) AS copies, CAST(sum(n_chars) AS BIGINT) AS total_bytes, min('m' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS first_id
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(t: Tables):
    """Documents arrive as five files, a batch each; the log is folded by twos."""
    arriving = new_table_path(t.spark, "arriving")
    items = t.raw("documents").select(
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id"),
        F.col("n_chars").alias("size_bytes"),
    )
    items.repartition(5, F.xxhash64("media_id")).write.parquet(arriving)
    source = t.spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    log = levels.LevelledLog(t.spark, new_table_path(t.spark, "levels"), levels.fold_digests, fan=2)
    levels.stream_digests(source, log, new_table_path(t.spark, "checkpoint"), availableNow=True).awaitTermination()
    return log.view().filter("copies > 1")


@query(
    "stream_progress",
    with_(TREE_SQL) + """SELECT count(*) AS scanned, count(*) FILTER (ext <> '.txt') AS matched, CAST(sum(size_bytes) FILTER (ext <> '.txt') AS BIGINT) AS bytes FROM parted""",
)
def _(t: Tables):
    files = _listing_stream(t).withColumn("kind", classify_ext(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    log = new_table_path(t.spark, "progress")
    ingest.append_batches(ingest.with_progress(files), log, new_table_path(t.spark, "checkpoint"), availableNow=True).awaitTermination()
    return ingest.progress_of(t.spark.read.parquet(log)).agg(*[F.sum(c).alias(c) for c in ("scanned", "matched", "bytes")])


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT user_id AS library_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS photos FROM n GROUP BY user_id, no
    HAVING count(*) >= 3""",
)
def _(t: Tables):
    """Sessions the watermark has closed by the end of the stream, and those still open."""

    def photos(events: DataFrame) -> DataFrame:
        return events.select(F.col("user_id").alias("library_id"), F.col("ts").cast("timestamp").alias("taken_at"))

    closed = _finish(t, sessions.stream_sessions(photos(_stream(t, "events"))), "append").drop("batch")
    return sessions.sessions_view(closed, photos(t.raw("events")))
