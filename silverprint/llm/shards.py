"""A uniform shuffle into shards of exact sizes: hypergeometric counts, a permutation before and one after the exchange.

With ``n`` rows and ``s`` shards each shard takes ``n // s`` rows, the first ``n % s`` one more. How many rows of each
source partition go to each shard is drawn from the distribution that a uniform permutation of all rows would give: row by
row of the communication matrix, a multivariate hypergeometric draw from the room that the shards have left. Each source
permutes its rows where they lie, by a sort on a first random number, and cuts them by its counts; one exchange deals rows by
shard and leading part of a second random number, and its order there is the permutation within the shard.

Random numbers are drawn once and written with the permuted rows, so a lost executor repeats no draw. Places follow from the
numbers alone: rows with their texts move once. The driver sees one row of the matrix a source partition, and the number of
rows in each part of a shard, of which there are about as many as source partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverprint.workspace import materialise

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits

#: Numbers in a table of cuts or starts up to which it is broadcast (8 MiB); beyond that Spark chooses the join.
BROADCAST_NUMBERS = 1 << 20


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items out of ``good + bad`` are good, for any sizes.

    Rejection for discrete log-concave distributions: a flat top around the mode with exponential tails lies above every
    such distribution of the same peak.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = _log_choose(good + bad, drawn)
    chance = lambda k: math.exp(_log_choose(good, k) + _log_choose(bad, drawn - k) - total) if low <= k <= high else 0.0
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    peak = chance(mode)
    width = 1 + peak / 2
    while True:
        if rng.random() <= width / (1 + width):
            away = rng.random() * width / peak
        else:
            away = (width + rng.exponential()) / peak
        k = mode + round(away) * (1 if rng.random() < 0.5 else -1)
        if rng.random() * min(1.0, math.exp(width - peak * away)) <= chance(k) / peak:
            return k


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of each source that go to each shard; rows sum to the sources, columns to the shards."""
    rng = np.random.default_rng(seed)
    room, matrix = list(shards), []
    for rows in sources:
        left, beyond, row = rows, sum(room), []
        for shard, free in enumerate(room):
            beyond -= free
            taken = hypergeometric(rng, free, beyond, left)
            row.append(taken)
            room[shard] -= taken
            left -= taken
        matrix.append(row)
    return matrix


def _small(table: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table


def shuffle_into(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, a uniformly random place; slots of a shard have no gap and begin at 0.

    Any rows do: nulls, repeated rows and equal texts are each placed on their own. Columns called ``shard`` or ``slot`` are
    replaced. An empty table stays empty.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    permuted = rows.select(*columns, F.rand(seed).alias("_before"), F.rand(seed + 1).alias("_after")).sortWithinPartitions("_before")
    drawn = materialise(
        permuted.select(*columns, "_after", F.spark_partition_id().alias("_source"), F.monotonically_increasing_id().alias("_row")), "drawn"
    )
    counts = drawn.groupBy("_source").count().orderBy("_source").collect()  # one row a source partition
    total = sum(r["count"] for r in counts)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix([r["count"] for r in counts], sizes, seed)
    cuts = rows.sparkSession.createDataFrame(
        [(r["_source"], np.cumsum(row).tolist()) for r, row in zip(counts, matrix)], "_source int, _cuts array<long>"
    )
    at = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))  # place in the source's permutation, from 0
    parts = -(-len(counts) // shards)
    dealt = (
        drawn.join(_small(cuts, len(counts) * shards), "_source")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= at)))
        .withColumn("_part", F.floor(F.col("_after") * parts).cast("int"))
        .drop("_cuts")
    )
    starts, seen = [], {}
    for r in dealt.groupBy("shard", "_part").count().orderBy("shard", "_part").collect():  # one row a part of a shard
        starts.append((r["shard"], r["_part"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["count"]
    first = rows.sparkSession.createDataFrame(starts, "shard int, _part int, _first long")
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_after", "_row"))
    placed = dealt.withColumn("_at", within).join(_small(first, 3 * len(starts)), ["shard", "_part"])
    return placed.select(*columns, "shard", (F.col("_first") + F.col("_at") - 1).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Shuffled rows as one folder a shard, in several files where a shard is large, each sorted by slot."""
    shuffle_into(rows, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
