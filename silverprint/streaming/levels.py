"""A log of stream batches that is folded as it grows, in place of state that is kept for ever.

Each batch is written to a folder of its own. ``fan`` neighbouring folders of one width become one folder of ``fan`` times that
width, so a log of n batches has about ``fan * log(n)`` folders and each row is written again log(n) times: what a batch costs
follows the batch. Nothing is held between batches, neither in memory nor in a state store; the view is a query over the folders.

A folder counts once Spark has marked its write as complete. Folders that a wider one covers are passed over by readers and deleted by
the fold after the next one, so a query that began before a fold can end. A batch that is replayed replaces its own folder, and
is passed over where a wider folder holds it already.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_NAME = re.compile(r"batches-(\d+)-(\d+)")

Span = tuple[int, int]


class LevelledLog:
    """Batches below ``path``. ``fold`` reduces rows to fewer rows of the same columns that mean the same to every view."""

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark, self.path, self.fold, self.fan = spark, path.rstrip("/"), fold, fan
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, span: Span) -> str:
        return f"{self.path}/batches-{span[0]}-{span[1]}"

    def complete(self) -> list[Span]:
        """First and last batch of every folder that was written to its end."""
        root = self._hadoop.Path(self.path)
        if not self._fs.exists(root):
            return []
        spans = []
        for status in self._fs.listStatus(root):
            match = _NAME.fullmatch(status.getPath().getName())
            if match and self._fs.exists(self._hadoop.Path(status.getPath(), "_SUCCESS")):
                spans.append((int(match[1]), int(match[2])))
        return sorted(spans)

    def current(self) -> list[Span]:
        """The widest folders, which hold every batch once."""
        spans = self.complete()
        return [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]

    def read(self) -> DataFrame | None:
        """All rows of the log as they are stored; None before the first batch."""
        spans = self.current()
        return self.spark.read.parquet(*map(self._folder, spans)) if spans else None

    def view(self) -> DataFrame | None:
        """The log folded into one; None before the first batch."""
        rows = self.read()
        return None if rows is None else self.fold(rows)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch and fold what has become wide enough; for ``foreachBatch``."""
        if any(a <= batch_id <= b and a < b for a, b in self.current()):
            return
        self.fold(batch).write.mode("overwrite").parquet(self._folder((batch_id, batch_id)))
        self.compact()

    def compact(self) -> list[Span]:
        """Fold neighbouring folders of one width until no ``fan`` of them are left; the folders made."""
        made: list[Span] = []
        stale = set(self.complete()) - set(self.current())  # covered before this fold began
        while run := self._run():
            span = (run[0][0], run[-1][1])
            rows = self.spark.read.parquet(*map(self._folder, run))
            self.fold(rows).write.mode("overwrite").parquet(self._folder(span))
            made.append(span)
        if made:
            for span in stale:
                self._fs.delete(self._hadoop.Path(self._folder(span)), True)
        return made

    def _run(self) -> list[Span] | None:
        """The first ``fan`` neighbours of one width that fill a place of the next width."""
        spans = self.current()
        for at in range(len(spans) - self.fan + 1):
            run = spans[at : at + self.fan]
            width = run[0][1] - run[0][0] + 1
            joined = all(b[0] == a[1] + 1 for a, b in zip(run, run[1:]))
            if joined and all(b - a + 1 == width for a, b in run) and run[0][0] % (width * self.fan) == 0:
                return run
        return None


def fold_digests(rows: DataFrame) -> DataFrame:
    """Copies, bytes and first id of each digest."""
    return rows.groupBy("sha256").agg(F.sum("copies").alias("copies"), F.sum("total_bytes").alias("total_bytes"), F.min("first_id").alias("first_id"))


def fold_catalog(rows: DataFrame) -> DataFrame:
    """The two rows of each path that :func:`silverprint.streaming.ingest.catalog_view` reads: of the first and of the last batch."""
    late = [c for c in ("size_bytes", "last_modified", "sha256") if c in rows.columns]
    fixed = [c for c in rows.columns if c not in (*late, "path", "batch")]
    both = rows.groupBy("path").agg(
        F.min(F.struct("batch", *fixed, *late)).alias("_first"), F.max(F.struct("batch", *late, *fixed)).alias("_last")
    )
    last = F.struct(*[F.col(f"_last.{c}").alias(c) for c in ("batch", *fixed, *late)])
    kept = both.select("path", F.explode(F.array_distinct(F.array("_first", last))).alias("_r"))
    return kept.select("path", "_r.*").select(*rows.columns)


def stream_digests(items: DataFrame, log: LevelledLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Count the copies of each digest of ``items (sha256, size_bytes, media_id)`` as they arrive, in a levelled log.

    ``log`` folds with :func:`fold_digests`. Items without digest are passed over.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        one = batch.filter("sha256 IS NOT NULL").select("sha256", F.lit(1).cast("long").alias("copies"), F.col("size_bytes").cast("long").alias("total_bytes"), F.col("media_id").alias("first_id"))
        log.append(one, batch_id)

    return items.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_catalog(rows: DataFrame, log: LevelledLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every batch of classified files to a levelled log that folds with :func:`fold_catalog`."""

    def append(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()
