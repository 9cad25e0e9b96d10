"""A stored index of vectors: cells around fitted centres, one folder a cell, and exact top-k search that skips cells.

A cell knows its centre ``c`` and the distance ``r`` of its farthest member, so no member scores above ``q.c + |q| r`` against a query
``q``. The cells that promise most are read first; every cell that cannot reach the score of the last row found there is skipped.
How much that saves depends on the vectors: all of it is exact, but vectors without any clusters leave no cell to skip.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.functions.vectors import dot_with
from silverprint.operators.search import SEMANTIC_MIN, SEMANTIC_TOP

#: Cells of an index and vectors that their centres are fitted on; both bound what the driver holds.
CELLS = 256
SAMPLE = 8_192

#: Members that have no place among the centres: other lengths than the sample's.
ODD_CELL = -1


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of a bounded sample by farthest-first starts and a few rounds of means."""
    squares = (sample * sample).sum(1)

    def distances(centre: np.ndarray) -> np.ndarray:
        return np.maximum(squares - 2 * (sample @ centre) + centre @ centre, 0)

    centres = [sample[0]]
    away = distances(centres[0])
    while len(centres) < cells and away.max() > 1e-9 * (1 + squares.max()):  # copies do not make further centres
        centres.append(sample[int(away.argmax())])
        away = np.minimum(away, distances(centres[-1]))
    fitted = np.array(centres)
    for _ in range(rounds):
        nearest = _nearest(sample, fitted)
        order = np.argsort(nearest, kind="stable")
        used, starts = np.unique(nearest[order], return_index=True)
        fitted[used] = np.add.reduceat(sample[order], starts) / np.diff([*starts, len(sample)])[:, None]
    return fitted


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def build(items: DataFrame, path: str, id_col: str = "media_id", vector_col: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> None:
    """Write the index of all rows with a vector; ``sample`` rows, those with the smallest id hashes, fit the centres."""
    rows = items.filter(F.size(vector_col) > 0).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0).to_numpy()  # bounded by the parameter
    lengths = [len(v) for v in drawn]
    length = max(set(lengths), key=lengths.count) if lengths else 0
    fitting = [v for v in drawn if len(v) == length]
    centres = fit_centres(np.array(fitting, np.float64), cells) if fitting else np.zeros((0, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, distance = np.full(len(batch), ODD_CELL), np.full(len(batch), np.inf)
            usual = np.flatnonzero(batch["vector"].map(len).to_numpy() == length)
            if len(usual):
                vectors = np.stack(batch["vector"].to_numpy()[usual]).astype(np.float64)
                cell[usual] = _nearest(vectors, centres)
                distance[usual] = np.sqrt(((vectors - centres[cell[usual]]) ** 2).sum(1))
            yield batch.assign(cell=cell.astype(np.int32), distance=distance)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "vector")}
    placed = rows.mapInPandas(place, f"id {kinds['id']}, vector {kinds['vector']}, cell int, distance double")
    # ranges end in the id, so a cell full of copies is cut into several files
    ordered = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    ordered.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    written = items.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    radii = {r[0]: (r[1], r[2]) for r in written.groupBy("cell").agg(F.max("distance"), F.count(F.lit(1))).collect()}  # one row a cell
    facts = [(c, centres[c].tolist() if c >= 0 else [], float(r), n, placed.schema.json()) for c, (r, n) in radii.items()]
    table = items.sparkSession.createDataFrame(facts, "cell int, centre array<double>, radius double, members long, row_schema string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


class VectorIndex:
    """An index on disk; the table of cells, bounded by their number, is read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
        self.schema = T.StructType.fromJson(json.loads(self.cells[0]["row_schema"])) if self.cells else None

    def bounds(self, query: Sequence[float]) -> np.ndarray:
        """The highest score that each cell could hold."""
        q = np.asarray(query, np.float64)
        out = np.full(len(self.cells), np.inf)
        usual = [i for i, c in enumerate(self.cells) if len(c["centre"]) == len(q)]
        if usual:
            centres = np.array([self.cells[i]["centre"] for i in usual])
            radii = np.array([self.cells[i]["radius"] for i in usual])
            length = np.sqrt((q * q).sum())
            sums = centres @ q + length * radii
            out[usual] = sums + 1e-9 * (np.abs(sums) + length)  # rounding
        return out

    def rows(self, cells: Sequence[int]) -> DataFrame:
        """The members of some cells; no other folder is listed."""
        folders = [f"{self.path}/rows/cell={c}" for c in cells]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*folders)

    def _best(self, cells: Sequence[int], query: Sequence[float], top: int) -> DataFrame:
        scored = self.rows(cells).select(F.col("id").alias("media_id"), dot_with(F.col("vector"), query).alias("score"))
        return scored.orderBy(F.col("score").desc(), "media_id").limit(top)

    def _plan(self, query: Sequence[float], top: int, min_score: float) -> tuple[list, list[int], list[int]]:
        """The best rows of the most promising cells, these cells, and the others that may hold a better one."""
        bounds = self.bounds(query)
        order = np.argsort(-bounds, kind="stable")
        members = np.cumsum([self.cells[i]["members"] for i in order])
        first = order[: int(np.searchsorted(members, top)) + 1]
        name = lambda places: [self.cells[i]["cell"] for i in places]
        found = self._best(name(first), query, top).collect()  # at most ``top`` rows
        least = max(min_score, found[-1][1]) if len(found) == top else min_score
        return found, name(first), name(i for i in order[len(first) :] if bounds[i] >= least)

    def cells_for(self, query: Sequence[float], top: int, min_score: float) -> list[int]:
        """The cells that a search reads."""
        _, first, others = self._plan(query, top, min_score)
        return first + others

    def search(self, query: Sequence[float], top: int = SEMANTIC_TOP, min_score: float = SEMANTIC_MIN) -> DataFrame:
        """``media_id`` and ``score``: the rows that a scan of all vectors gives."""
        if not self.cells:
            return self.spark.createDataFrame([], "media_id string, score double")
        found, first, others = self._plan(query, top, min_score)
        kind = self.schema["id"].dataType.simpleString()
        best = self.spark.createDataFrame(found, f"media_id {kind}, score double")
        if others:
            best = best.unionByName(self._best(others, query, top)).orderBy(F.col("score").desc(), "media_id").limit(top)
        return best.filter(F.col("score") > min_score)
