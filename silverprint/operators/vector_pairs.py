"""Exact similarity self-join of vectors under an L2 bound.

Rows are assigned to the nearest of a few sampled centres. Two vectors closer than ``eps`` with
different home centres lie both within ``eps`` of the plane between the centres, so it is enough
that every row also visits the lower-numbered centres whose plane is that near. Cells are cut into
blocks of bounded size by a hash of the id; each task compares two blocks strip by strip with matrix products.
Where rows would visit so many cells that moving them costs more than a few copies of the table, as with a wide bound in
high dimension, nothing is copied: blocks are rows of a table, and a nested-loop join hands those that may be close to Python.
Copies of a vector are collapsed before the join, so they never multiply the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.operators.components import connected_components, star_links
from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise

# Two faces belong together below this distance; similar photos from this cosine on.
FACE_EPS = 0.55
SIMILAR_COSINE = 0.92

_SLACK = 1e-6

# What a task holds at once, whatever the input: distances to centres, values of differences, rows handed on (at 64 values 4 MB),
# and a product, which stays in the processor's cache.
_CELLS_AT_ONCE = 1 << 20
_VALUES_AT_ONCE = 1 << 21
_ROWS_OUT = 8_192
_TILE = (1024, 512)
# Values of a block that is a row (4 MB), bytes of the blocks that a task of the nested loop holds, and rows it keeps labels of.
_BLOCK_VALUES = 1 << 19
_SIDE_BYTES = 32 << 20
_LABELS_AT_ONCE = 1 << 20


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per distinct vector: the smallest id holding it and the number of copies."""
    return (
        df.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
        .groupBy(F.col(vec_col).cast("array<double>").alias("vec"))
        .agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))
    )


def _homes(centres: np.ndarray, eps: float):
    """Home centre of each vector, and which lower centres it visits."""
    gaps = np.sqrt(np.maximum(np.array([((centres - c) ** 2).sum(-1) for c in centres]), 1e-300))

    def homes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squared = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2.0 * vectors @ centres.T
        home = squared.argmin(1)
        own = squared[np.arange(len(home)), home]
        to_plane = (squared - own[:, None]) / (2.0 * gaps[home])
        return home, (to_plane <= eps + _SLACK) & (np.arange(len(centres))[None, :] < home[:, None])

    return homes


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix; a null element is not a number."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("all vectors must have the same length")
    return values.reshape(len(column), -1)


def _place(centres: np.ndarray, eps: float):
    homes = _homes(centres, eps)
    step = max(1, _CELLS_AT_ONCE // len(centres))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), step):
                reps = batch["rep"].to_numpy()[start : start + step]
                vecs = batch["vec"].to_numpy()[start : start + step]
                home, visits = homes(np.stack(vecs))
                rows, cells = np.nonzero(visits)
                cell = np.concatenate([home, cells])
                visitor = np.arange(len(cell)) >= len(home)
                row = np.concatenate([np.arange(len(home)), rows])
                for at in range(0, len(row), _ROWS_OUT):  # a row may visit very many cells
                    part = slice(at, at + _ROWS_OUT)
                    yield pd.DataFrame(
                        {"cell": cell[part], "visitor": visitor[part], "rep": reps[row[part]], "vec": list(vecs[row[part]])}
                    )

    return place


def _census(centres: np.ndarray, eps: float):
    """Rows at home and visiting, per cell: what ``_place`` would hand on, counted only."""
    homes = _homes(centres, eps)
    step = max(1, _CELLS_AT_ONCE // len(centres))

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home, visiting = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in (b for b in batches if b.num_rows):
            vectors = _matrix(batch.column("vec"))
            for start in range(0, len(vectors), step):
                home, visits = homes(vectors[start : start + step])
                at_home += np.bincount(home, minlength=len(centres))
                visiting += visits.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(at_home), pa.array(visiting)], ["cell", "homes", "visits"])

    return census


def _scaled(x: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices and a floor: rows closer than ``eps`` have a product of at least ``floor``.

    The product is minus half the squared distance, in single precision if its rounding error, which the floor makes up for, is
    small beside the bound. The origin is moved to the middle of ``y`` to keep that error small.
    """
    middle = y.mean(0)
    x, y = x - middle, y - middle
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    reach = (math.sqrt(xx.max()) + math.sqrt(yy.max())) ** 2
    kind = next((k for k in (np.float32, np.float64) if reach < 1e30 and 2 * (x.shape[1] + 8) * np.finfo(k).eps * reach <= 0.01 * eps * eps), np.float64)
    slack = 2 * (x.shape[1] + 8) * np.finfo(kind).eps * reach + _SLACK
    left, right = np.empty((len(x), x.shape[1] + 2), kind), np.empty((len(y), x.shape[1] + 2), kind)
    left[:, :-2], left[:, -2], left[:, -1] = x, -xx / 2, 1
    right[:, :-2], right[:, -2], right[:, -1] = y, 1, -yy / 2
    return left, right, -(eps * eps + slack) / 2


def _true_at(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a mask in row order, looked for eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    word = np.flatnonzero(flat[:whole].view(np.uint64))
    part, byte = np.nonzero(flat[:whole].reshape(-1, 8)[word])
    return np.concatenate([word[part] * 8 + byte, whole + np.flatnonzero(flat[whole:])])


def _close_pairs(x: np.ndarray, y: np.ndarray, eps: float, same: bool, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of ``x`` and ``y`` that are close, and their distances, a bounded number at once.

    Pairs with one ``label`` are passed over; it is the caller's and may change in between.
    """
    pairs = max(1, _VALUES_AT_ONCE // x.shape[1])
    left, right, floor = _scaled(x, y, eps)
    tall, wide = _TILE

    def exact(all_i: np.ndarray, all_j: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, len(all_i), pairs):
            i, j = all_i[at : at + pairs], all_j[at : at + pairs]
            if label is not None:
                other = j if same else j + len(x)
                i, j = i[label[i] != label[other]], j[label[i] != label[other]]
            distance = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
            close = distance < eps
            yield i[close], j[close], distance[close]

    held, found = 0, []
    for top in range(0, len(x), tall):
        for at in range(0, len(y), wide):
            if same and at + wide <= top:
                continue
            tile = left[top : top + tall] @ right[at : at + wide].T
            i, j = np.divmod(_true_at(tile >= floor), tile.shape[1])
            i, j = i + top, j + at
            if same:
                i, j = i[i < j], j[i < j]
            held, found = held + len(i), [*found, (i, j)]
            if held >= pairs:
                yield from exact(*map(np.concatenate, zip(*found)))
                held, found = 0, []
    if held:
        yield from exact(*map(np.concatenate, zip(*found)))


def _compare(eps: float, links_only: bool):
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(parts))
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        same = bool(block["same"].iat[0])
        if same:
            right = left
        if left.empty or right.empty:
            return
        p, q = left["rep"].to_numpy(), right["rep"].to_numpy()
        x = np.stack(left["vec"].to_numpy())
        y = x if same else np.stack(right["vec"].to_numpy())
        reps = p if same else np.concatenate([p, q])
        label = np.arange(len(reps)) if links_only else None
        for i, j, exact in _close_pairs(x, y, eps, same, label):
            if not links_only:
                swap = p[i] > q[j]
                yield pd.DataFrame({"a": np.where(swap, q[j], p[i]), "b": np.where(swap, p[i], q[j]), "distance": exact})
            elif len(i):
                known = np.flatnonzero(label != np.arange(len(label)))
                nodes, roots = star_links(np.concatenate([known, i]), np.concatenate([label[known], j if same else j + len(x)]))
                label[nodes] = roots
        if links_only:
            moved = np.flatnonzero(label != np.arange(len(label)))
            a, b = reps[label[moved]], reps[moved]
            swap = a > b
            yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "distance": np.zeros(len(a))})

    return compare


def _at_home(centres: np.ndarray):
    homes = _homes(centres, 0.0)
    step = max(1, _CELLS_AT_ONCE // len(centres))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            vectors = _matrix(batch.column("vec"))
            cell = [homes(vectors[at : at + step])[0] for at in range(0, len(vectors), step)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), *batch.columns], ["cell", *batch.schema.names])

    return at_home


def _blocks(block_rows: int):
    """Neighbouring rows of one cell as one row: their ids and one matrix, with the middle and the radius around it."""

    def block(number: int, ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        vectors, ids = np.concatenate(rows), pa.concat_arrays(ids)
        middle = vectors.mean(0)
        radius = math.sqrt(((vectors - middle) ** 2).sum(1).max())
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns = [pa.array([number]), pa.array([middle]), pa.array([radius]), listed, pa.array([vectors.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "middle", "radius", "ids", "vectors"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held, at, ids, rows = 0, -1, [], []
        for batch in (b for b in batches if b.num_rows):
            cells, reps, vectors = batch.column("cell").to_numpy(), batch.column("rep"), _matrix(batch.column("vec"))
            start = 0
            while start < len(cells):
                if held and (cells[start] != at or held >= block_rows):
                    yield block(number, ids, rows)
                    number, held, ids, rows = number + 1, 0, [], []
                at = int(cells[start])
                end = min(start + block_rows - held, int(np.searchsorted(cells, at, "right")))
                ids.append(reps.slice(start, end - start))
                rows.append(vectors[start:end])
                held, start = held + end - start, end
        if held:
            yield block(number, ids, rows)

    return blocks


class _Labels:
    """Components among the rows of the blocks that a task has met, named by row numbers."""

    def __init__(self):
        self.label, self.starts, self.ids = np.arange(0), {}, []

    def rows(self, block: int, ids: pa.Array) -> np.ndarray:
        """Numbers of a block's rows."""
        if block not in self.starts:
            self.starts[block] = len(self.label)
            self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + len(ids))])
            self.ids.append(ids)
        return self.starts[block] + np.arange(len(ids))

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        nodes, roots = star_links(self.label[p], self.label[q])
        to = np.arange(len(self.label))
        to[nodes] = roots
        self.label = to[self.label]

    def links(self) -> Iterator[pa.RecordBatch]:
        """A link from each row to the first of its component; then everything is forgotten."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        ids = pa.concat_arrays(self.ids) if self.ids else None
        for at in range(0, len(moved), _ROWS_OUT):
            part = moved[at : at + _ROWS_OUT]
            yield _pair_batch(ids.take(pa.array(self.label[part])), ids.take(pa.array(part)), np.zeros(len(part)))
        self.__init__()


def _pair_batch(a: pa.Array, b: pa.Array, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, pa.array(distance)], ["a", "b", "distance"])


def _meet(eps: float, links_only: bool):
    """Close pairs of the rows of two blocks, for each row that holds two."""

    def in_reach(x: np.ndarray, y: np.ndarray, mid_a: np.ndarray, mid_b: np.ndarray, radius_a: float, radius_b: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two blocks that can be close to one of the other: by its ball, and along the line between the middles."""
        across = mid_b - mid_a
        gap = math.sqrt((across**2).sum())
        rounding = 8 * x.shape[1] * np.finfo(float).eps * (radius_a + radius_b + gap) + _SLACK
        along, other = (x - mid_a) @ across, (y - mid_a) @ across
        near_x = np.sqrt(((x - mid_b) ** 2).sum(1)) <= radius_b + eps + rounding
        near_y = np.sqrt(((y - mid_a) ** 2).sum(1)) <= radius_a + eps + rounding
        near_x &= along >= other.min() - (eps + rounding) * gap
        near_y &= other <= along.max() + (eps + rounding) * gap
        return np.flatnonzero(near_x), np.flatnonzero(near_y)

    def parts(la: np.ndarray, lb: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows to compare, without those pairs that have the most common label on both sides."""
        names, counts = np.unique(la[i], return_counts=True)
        most = names[counts.argmax()]
        in_a, in_b = la[i] == most, lb[j] == most
        yield from ((i[~in_a], j), (i[in_a], j[~in_b])) if in_b.any() else ((i, j),)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels()
        for batch in batches:
            for row in range(batch.num_rows):
                entry = {name: batch.column(name)[row] for name in batch.schema.names}
                number = {k: entry[k].as_py() for k in ("block_a", "block_b", "radius_a", "radius_b")}
                ids = [entry[k].values for k in ("ids_a", "ids_b")]
                x, y = (np.frombuffer(entry[f"vectors_{k}"].as_buffer()).reshape(len(own), -1) for k, own in zip("ab", ids))
                same = number["block_a"] == number["block_b"]
                if same:
                    i = j = np.arange(len(x))
                else:
                    middles = (entry[f"middle_{k}"].values.to_numpy() for k in "ab")
                    i, j = in_reach(x, y, *middles, number["radius_a"], number["radius_b"])
                if not len(i) or not len(j):
                    continue
                if not links_only:
                    for p, q, exact in _close_pairs(x[i], y[j], eps, same):
                        yield _pair_batch(ids[0].take(pa.array(i[p])), ids[1].take(pa.array(j[q])), exact)
                    continue
                if len(labels.label) > _LABELS_AT_ONCE:
                    yield from labels.links()
                rows_a, rows_b = (labels.rows(number[f"block_{k}"], own) for k, own in zip("ab", ids))
                la, lb = labels.label[rows_a], labels.label[rows_b]
                if same and (la == la[0]).all():
                    continue
                for i, j in ((i, j),) if same else tuple(parts(la, lb, i, j)):
                    if not len(i) or not len(j):
                        continue
                    both = rows_a[i] if same else np.concatenate([rows_a[i], rows_b[j]])
                    label = labels.label[both]
                    for p, q, _ in _close_pairs(x[i], y[j], eps, same, label):
                        if len(p):
                            labels.join(rows_a[i[p]], rows_b[j[q]])
                            label[:] = labels.label[both]
        yield from labels.links()

    return meet


def _nested_pairs(distinct: DataFrame, centres: np.ndarray, count: int, eps: float, block_rows: int, links_only: bool) -> DataFrame:
    """``l2_pairs`` without copies of rows: every two blocks that can be close meet in a nested-loop join.

    The table of blocks is as large as the vectors and is moved once; a task reads a share of it and holds another of bounded size.
    """
    id_type = distinct.schema["rep"].dataType.simpleString()
    width = centres.shape[1]
    block_rows = max(1, min(4 * block_rows, _BLOCK_VALUES // width))
    shares = min(math.ceil(count / block_rows), max(8, math.ceil(count * (8 * width + 32) / _SIDE_BYTES)))
    placed = distinct.mapInArrow(_at_home(centres), f"cell long, rep {id_type}, vec array<double>")
    ranged = placed.repartitionByRange(shares, "cell", F.xxhash64("rep")).sortWithinPartitions("cell")
    columns = f"block long, middle array<double>, radius double, ids array<{id_type}>, vectors binary"
    blocks = materialise(ranged.mapInArrow(_blocks(block_rows), columns), "blocks")
    left, right = (
        side.select(*[F.col(c).alias(f"{c}_{end}") for c in blocks.columns])
        for side, end in ((blocks, "a"), (blocks.repartition(shares, "block"), "b"))
    )
    a, b = F.col("block_a"), F.col("block_b")
    # each two blocks once, whichever of the two comes first: so all tasks have the like share of them
    once = (a == b) | ((a < b) == (F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(2)) == 0)) & (a != b)
    squares = F.zip_with("middle_a", "middle_b", lambda p, q: (p - q) * (p - q))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, square: total + square))
    close = apart <= (F.col("radius_a") + F.col("radius_b") + eps) * (1 + 1e-9) + _SLACK
    met = left.hint("shuffle_replicate_nl").join(right, once & ((a == b) | close))
    pairs = met.mapInArrow(_meet(eps, links_only), f"a {id_type}, b {id_type}, distance double")
    swap = F.col("a") > F.col("b")
    return pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "distance")


def l2_pairs(
    distinct: DataFrame,
    eps: float,
    cell_rows: int = 4096,
    block_rows: int = 2048,
    max_centres: int = 2048,
    links_only: bool = False,
    most_copies: float = 6,
) -> DataFrame:
    """``(a, b, distance)`` of all distinct vectors closer than ``eps`` (strict), each pair once.

    With ``links_only`` every task thins its pairs to links with the same components (and without
    distances), so a dense cluster costs one link per vector and task instead of one row per pair.
    Rows are copied to cells and blocks if that makes at most ``most_copies`` of each on average, else blocks meet in a
    nested loop; the pairs are the same.
    """
    spark = distinct.sparkSession
    id_type = distinct.schema["rep"].dataType.simpleString()
    # a vector whose squares have no finite sum is close to nothing
    finite = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x) < 1e300
    distinct = materialise(distinct.filter(finite).select("rep", "vec"), "vectors")
    count = distinct.count()
    wanted = max(1, min(max_centres, math.ceil(count / cell_rows)))
    chosen = distinct.orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()  # at most max_centres rows
    if not chosen:
        return spark.createDataFrame([], f"a {id_type}, b {id_type}, distance double")
    centres = np.array([row["vec"] for row in chosen], dtype=float)

    census = distinct.mapInArrow(_census(centres, eps), "cell long, homes long, visits long")
    copies = 0
    for row in census.groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).collect():  # one row per centre
        at_home, visiting = math.ceil(row["homes"] / block_rows), math.ceil(row["visits"] / block_rows)
        copies += row["homes"] * (at_home + visiting) + row["visits"] * (at_home + 1)
    if copies > most_copies * count:
        return _nested_pairs(distinct, centres, count, eps, block_rows, links_only)

    placed = materialise(
        distinct.mapInPandas(
            _place(centres, eps), f"cell long, visitor boolean, rep {id_type}, vec array<double>"
        ),
        "cells",
    )
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("visitor")) / block_rows).cast("int").alias("home_blocks"),
        F.ceil(F.count_if(F.col("visitor")) / block_rows).cast("int").alias("visit_blocks"),
    )
    located = placed.join(F.broadcast(sizes), "cell")  # one row per centre

    blocks = F.when(F.col("visitor"), F.col("visit_blocks")).otherwise(F.col("home_blocks"))
    located = located.withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(blocks, F.lit(1))).cast("int"))
    homes = F.sequence(F.lit(0), F.col("home_blocks") - 1)

    def task(visits: bool, i, j, side, same):
        return F.struct(
            F.lit(visits).alias("visits"),
            i.cast("int").alias("i"),
            j.cast("int").alias("j"),
            side.cast("int").alias("side"),
            same.alias("same"),
        )

    mine = F.col("block")
    among_homes = F.transform(
        homes,
        lambda other: task(
            False, F.least(mine, other), F.greatest(mine, other), F.when(mine <= other, 0).otherwise(1), mine == other
        ),
    )
    host_visits = F.when(
        F.col("visit_blocks") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("visit_blocks") - 1), lambda other: task(True, mine, other, F.lit(0), F.lit(False))
        ),
    ).otherwise(F.array().cast("array<struct<visits:boolean,i:int,j:int,side:int,same:boolean>>"))
    pay_visits = F.transform(homes, lambda other: task(True, other, mine, F.lit(1), F.lit(False)))
    tasks = F.when(F.col("visitor"), pay_visits).otherwise(F.concat(among_homes, host_visits))
    return (
        located.filter(F.col("home_blocks") > 0)
        .withColumn("_t", F.explode(tasks))
        .select("cell", "_t.visits", "_t.i", "_t.j", "_t.side", "_t.same", "rep", "vec")
        .groupBy("cell", "visits", "i", "j")
        .applyInPandas(_compare(eps, links_only), f"a {id_type}, b {id_type}, distance double")
    )


def vector_components(df: DataFrame, id_col: str, vec_col: str, eps: float, **tuning: int) -> DataFrame:
    """``(id, component)`` of every row with a neighbour closer than ``eps``; named by the smallest id.

    Copies of one vector are joined to their first copy, so a vector held by a third of all rows
    costs one node in the graph.
    """
    distinct = materialise(distinct_vectors(df, id_col, vec_col), "distinct_vectors")
    links = l2_pairs(distinct, eps, links_only=True, **tuning)
    linked = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    # equal vectors are at distance 0, so copies form a component even without other neighbours
    facts = (
        distinct.join(linked, "rep", "left")
        .filter(F.col("component").isNotNull() | (F.col("copies") > 1))
        .select("vec", F.coalesce("component", "rep").alias("component"), "copies")
    )
    rows = df.filter(F.col(vec_col).isNotNull()).select(
        F.col(id_col), F.col(vec_col).cast("array<double>").alias("vec")
    )
    return attach_facts(rows, facts, ["vec"], F.col("copies"), id_col).select(id_col, "component")


def eps_of_cosine(cosine: float) -> float:
    """L2 bound on unit vectors that a cosine bound amounts to."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine))


def similar_pairs(unit_vectors: DataFrame, id_col: str, vec_col: str, cosine: float = SIMILAR_COSINE, **tuning: int) -> DataFrame:
    """``(a, b, cosine)`` of distinct unit vectors whose cosine reaches the bound, each pair once.

    The L2 join is asked for slightly more than the bound; the cosine decides.
    """
    distinct = distinct_vectors(unit_vectors, id_col, vec_col)
    pairs = l2_pairs(distinct, eps_of_cosine(cosine) + _SLACK, **tuning)
    found = pairs.withColumn("cosine", 1 - F.col("distance") * F.col("distance") / 2)
    return found.filter(F.col("cosine") >= cosine).select("a", "b", "cosine")
