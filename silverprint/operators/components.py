"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise, release


#: Links that one task settles at once (16 bytes each); more take the rounds.
ONE_TASK = 200_000


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components: every node but the smallest points at the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        lower = label.copy()
        np.minimum.at(lower, i, low)
        np.minimum.at(lower, j, low)
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def thin_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Replace the pairs of each batch by star links, at most one per node of the batch.

    Valid for any subset of the pairs, so rows stay where they are and nothing is shuffled: a dense group that
    came out of a join no longer hands all its pairs to the component search.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hi, lo = star_links(batch[a].to_numpy(), batch[b].to_numpy())
            yield pd.DataFrame({a: lo, b: hi})

    kind = pairs.schema[a].dataType.simpleString()
    return pairs.select(a, b).mapInPandas(thin, f"{a} {kind}, {b} {kind}")


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    ends = F.array(
        F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")),
        F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")),
    )
    roots = (
        edges.select(F.inline(ends))
        .groupBy("node")
        .agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("degree"))
        .select(F.col("node").alias("lo"), F.least("other", "node").alias("root"), "degree")
    )
    hung = attach_facts(edges, roots, ["lo"], F.col("degree"), "hi", hot_rows)
    return hung.select("hi", F.col("root").alias("lo")).distinct()


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    roots = edges.groupBy("hi").agg(F.min("lo").alias("root"), F.count(F.lit(1)).alias("degree"))
    rooted = attach_facts(edges, roots, ["hi"], F.col("degree"), "lo", hot_rows)
    # the row of the root itself stands for the edge from the node to its root
    moved = F.when(F.col("lo") == F.col("root"), F.col("hi")).otherwise(F.col("lo"))
    return rooted.select(moved.alias("hi"), F.col("root").alias("lo")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a scratch table, and a fingerprint of the set that the write itself gathers."""
    seen = Observation()
    table = materialise(
        edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.bit_xor(F.xxhash64("lo", "hi")).alias("y")),
        "edges",
    )
    return table, (seen.get["n"], seen.get["x"], seen.get["y"])


def _settled(edges: DataFrame) -> DataFrame:
    """Links to the smallest node of each component, found by one task."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(batches)
        hi, lo = star_links(held["lo"].to_numpy(), held["hi"].to_numpy())
        yield pd.DataFrame({"hi": hi, "lo": lo})

    return edges.repartition(1).mapInPandas(settle, edges.schema)


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int | None = None, one_task: int = ONE_TASK
) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is named by its smallest node.

    The number of edges never grows and the number of rounds is logarithmic even for long chains. A round is one
    write; the search ends when a round leaves the set of edges as it was. Hubs are handled by
    :func:`attach_facts`, each round starts from a written table. Up to ``one_task`` links are settled by a single
    task instead, with the same result.
    """
    canonical = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).filter("hi <> lo")
    current, mark = _written(thin_edges(canonical, "lo", "hi").select("hi", "lo").distinct())
    if 0 < mark[0] <= one_task:
        settled = materialise(_settled(current), "edges")
        release(current)
        current, mark = settled, (0,)
    while mark[0]:
        following, next_mark = _written(_small_star(_large_star(current, hot_rows), hot_rows))
        release(current)
        current = following
        if next_mark == mark:
            break
        mark = next_mark
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
