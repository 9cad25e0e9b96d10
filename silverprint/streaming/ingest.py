"""Files as they arrive: classified, logged, counted and checked for known content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from silverprint.operators.classify import with_path_class
from silverprint.sources.listing import IGNORED_DIRS, media_listing, with_digests
from silverprint.sources.tree import stream_tree


def file_stream(spark: SparkSession, root: str, with_content: bool = True, settle_seconds: float = 1) -> DataFrame:
    """New and changed media files below ``root`` as a stream of path, size, time and digest.

    Only media files are opened, and they are read in chunks, whatever their size.
    """
    files = stream_tree(spark, root.rstrip("/"), IGNORED_DIRS, settle_seconds).filter("error IS NULL").drop("error")
    media = media_listing(files, root=root.rstrip("/")).select("path", "size_bytes", "last_modified")
    return with_digests(media) if with_content else media


def stream_ingest(files: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every batch of media files to a change log, one folder per batch.

    A replayed batch overwrites its own folder, so the log holds each batch once. Only the arriving
    rows are written; :func:`catalog_view` merges when it reads.
    """
    rows = with_path_class(media_listing(files), "server")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def catalog_view(log: DataFrame) -> DataFrame:
    """The catalog behind a change log: first seen values by path, size and time of the last batch."""
    changing = ("size_bytes", "last_modified", "sha256")
    late = [c for c in changing if c in log.columns]
    fixed = [c for c in log.columns if c not in (*late, "path", "batch")]
    merged = log.groupBy("path").agg(
        F.min(F.struct("batch", *fixed)).alias("_first"), F.max(F.struct("batch", *late)).alias("_last")
    )
    return merged.select("path", *[f"_first.{c}" for c in fixed], *[f"_last.{c}" for c in late])


def stream_exact_dups(items: DataFrame) -> DataFrame:
    """Digests seen more than once so far, for update mode: copies, bytes and the first id."""
    return (
        items.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.sum("size_bytes").alias("total_bytes"), F.min("media_id").alias("first_id"))
        .filter("copies > 1")
    )


def latest_updates(updates: DataFrame, key: str = "sha256") -> DataFrame:
    """What an update-mode log says now: the update of the last batch per key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("_l"))
    return last.select(key, *[f"_l.{c}" for c in rest])


def stream_new_content(items: DataFrame, time_col: str, within: str) -> DataFrame:
    """First row of each digest within the watermark; state is dropped once it is older."""
    return items.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["sha256"])


def with_progress(files: DataFrame, name: str = "scan") -> DataFrame:
    """Count scanned and matched files while the batch runs, without a second pass."""
    matched = F.col("kind") != "UNKNOWN"
    return files.observe(
        name,
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(matched).alias("matched"),
        F.coalesce(F.sum(F.when(matched, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
    )


def progress_of(log: DataFrame) -> DataFrame:
    """Counters of each batch in a log of :func:`append_batches`, however many batches there were."""
    matched = F.col("kind") != "UNKNOWN"
    return log.groupBy("batch").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(matched).alias("matched"),
        F.coalesce(F.sum(F.when(matched, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
    )


class ProgressListener(StreamingQueryListener):
    """Keeps the observed counters and the phase of each query."""

    def __init__(self, name: str = "scan"):
        self.name = name
        self.phase: dict[str, str] = {}
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.phase[str(event.id)] = "enumerating"

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        key = str(event.progress.id)
        self.phase[key] = "hashing"
        if row is not None:
            total = self.totals.setdefault(key, {})
            for counter, value in row.asDict().items():
                total[counter] = total.get(counter, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.phase[str(event.id)] = "done" if event.exception is None else "failed"


def append_batches(stream: DataFrame, log: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write any stream as one idempotent folder per batch."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
