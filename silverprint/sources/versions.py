"""Tables of one catalog whose versions switch together, and merges that rewrite only what a batch touches.

Every table is cut into parts by a SQL expression over its rows, such as a hash of its key. The files of a part lie in a folder of
their own that is never changed again. A manifest names the folders of all parts of all tables; a commit writes new folders for
the touched parts and then one new manifest, which only one writer can create. A reader holds on to one manifest, so it sees all tables
before a commit or all after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "_part"


def _label(part: str) -> Column:
    """The part of a row; rows for which the expression is null share one."""
    return F.coalesce(F.expr(part).cast("string"), F.lit("-"))


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed, the merge can be run again."""


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of all commits, oldest first."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a commit, by default the last complete one."""
        for number in [version] if version is not None else reversed(self.versions()):
            stream = self._fs.open(self._hadoop.Path(self._manifest_path(number)))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:  # still being written
                continue
        return {"version": 0, "tables": {}}

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:08d}.json"

    def _commit(self, base: dict, changes: dict[str, dict]) -> int:
        """``changes``: per table its new entry. Fails if the version after ``base`` is there already."""
        version = base["version"] + 1
        text = json.dumps({"version": version, "tables": base["tables"] | changes})
        # written under another name first: a manifest is there whole or not at all
        draft = self._hadoop.Path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._hadoop.Path(self._manifest_path(version))), no_overwrite)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} is there already") from None
            raise
        return version

    # -- reading --------------------------------------------------------------------------------

    def read(self, table: str, manifest: dict | None = None, parts: set[str] | None = None) -> DataFrame:
        """One table of a manifest, or some of its parts."""
        entry = (manifest or self.manifest())["tables"][table]
        schema = T.StructType.fromJson(entry["schema"])
        folders = sorted(f"{self.path}/{f}" for p, f in entry["folders"].items() if parts is None or p in parts)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # -- writing --------------------------------------------------------------------------------

    def _written(self, rows: DataFrame, part: str) -> tuple[dict, dict[str, str]]:
        """Write ``rows`` by part; their schema and the folder of each part that has rows."""
        base = f"data/{uuid.uuid4().hex}"
        labelled = rows.withColumn(_PART, _label(part))
        # ranges, so that a large part is written by several tasks and small ones share a task
        labelled.repartitionByRange(_PART, F.xxhash64(rows.columns[0])).write.partitionBy(_PART).parquet(f"{self.path}/{base}")
        folders = {}
        for status in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{base}")):
            name = status.getPath().getName()
            if name.startswith(f"{_PART}="):
                folders[name.removeprefix(f"{_PART}=")] = f"{base}/{name}"
        return json.loads(rows.schema.json()), folders

    def create(self, table: str, rows: DataFrame, part: str) -> int:
        """A new table, cut by the SQL expression ``part``, whose values are folder names: digits, letters, dashes."""
        base = self.manifest()
        if table in base["tables"]:
            raise ValueError(f"{table} is there already")
        schema, folders = self._written(rows, part)
        return self._commit(base, {table: {"part": part, "schema": schema, "folders": folders}})

    def merge(self, table: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the parts that ``batch`` touches by ``change(rows of these parts, batch)``.

        The part expression must hold for the batch's rows as well, and ``change`` must not move rows to other parts.
        """
        base = self.manifest()
        entry = base["tables"][table]
        touched = {r[0] for r in batch.select(_label(entry["part"])).distinct().collect()}  # at most one a part
        if not touched:
            return base["version"]
        schema, folders = self._written(change(self.read(table, base, touched), batch), entry["part"])
        if not set(folders) <= touched:
            raise ValueError(f"the merge wrote to parts that the batch does not touch: {sorted(set(folders) - touched)[:5]}")
        kept = {p: f for p, f in entry["folders"].items() if p not in touched}
        return self._commit(base, {table: {"part": entry["part"], "schema": schema, "folders": kept | folders}})

    def replace(self, tables: dict[str, DataFrame], parts: list[str]) -> int:
        """Put new rows in the place of ``parts`` of several tables, all in one commit. Parts without rows become empty."""
        return self.switch({table: (rows, set(parts)) for table, rows in tables.items()}, self.manifest())

    def switch(self, changes: dict[str, tuple[DataFrame, set[str]]], base: dict) -> int:
        """Put new rows in the place of each table's own parts, all in one commit on top of the manifest ``base``.

        Rows that belong to other parts are left out; parts without rows become empty.
        """
        entries = {}
        for table, (rows, parts) in changes.items():
            entry = base["tables"][table]
            schema, folders = self._written(rows.select(*[f["name"] for f in entry["schema"]["fields"]]).filter(_label(entry["part"]).isin(sorted(parts))), entry["part"])
            kept = {p: f for p, f in entry["folders"].items() if p not in parts}
            entries[table] = {"part": entry["part"], "schema": schema, "folders": kept | folders}
        return self._commit(base, entries)

    def expire(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete the folders only they had. Run while nobody writes."""
        numbers = self.versions()
        old, kept = numbers[: max(0, len(numbers) - keep)], numbers[-keep:]
        used = {f for v in kept for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        gone = {f for v in old for t in self.manifest(v)["tables"].values() for f in t["folders"].values()} - used
        for folder in sorted(gone):
            self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
        for version in old:
            self._fs.delete(self._hadoop.Path(self._manifest_path(version)), False)
        return len(gone)
