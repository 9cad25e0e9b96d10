"""The trie of shared conversation openings, from sorted sequences, their common prefix lengths and range minima.

Conversations are sequences of turn keys. Equal sequences become one row; these are range-sorted, and each sorted partition builds
its part of the trie: with the common prefix length of every row and the one before it, a node of depth ``d`` first met at row
``x`` spans the rows around ``x`` between which no length falls below ``d``. Both ends are found by binary search on a sparse
table of minima of 1, 2, 4, ... lengths, for all candidate prefixes at once and each on its own. Members, leaves and tokens are then
differences of running sums, the smallest id is a range minimum.

Only prefixes shared across the border of two partitions are left open: their parts are sums, added up by the digest of the prefix.
What is counted once (a node's own tokens, a child, a leaf) is counted by the first partition that has it. So a first turn shared
by a third of all conversations is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise

#: Ids joined into one row before they are digested.
CHUNK_IDS = 8_192

_NODES = (
    "depth long, conv_id long, key string, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
NO_IDS = hashlib.sha256(b"").hexdigest()


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """``levels[k][i]`` is the least of ``values[i : i + 2**k]``."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def right_ends(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The last row up to which every common prefix length after ``rows`` is at least ``depths``."""
    ends, n = rows.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero(ends + step < n)
        fits = fits[levels[k][ends[fits] + 1] >= depths[fits]]
        ends[fits] += step
    return ends


def left_ends(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The first row from which every common prefix length up to ``rows`` is at least ``depths``."""
    ends = rows.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero(ends - step >= 0)
        fits = fits[levels[k][ends[fits] - step + 1] >= depths[fits]]
        ends[fits] -= step
    return ends


def range_minima(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for level in np.unique(k):
        here = np.flatnonzero(k == level)
        out[here] = np.minimum(levels[level][first[here]], levels[level][last[here] + 1 - (1 << int(level))])
    return out


def common_prefix(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low keys agree, the first high do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _prefix_digests(keys: list[str], upto: int) -> list[str]:
    running, out = hashlib.sha256(), []
    for depth in range(upto + 1):
        if depth:
            running.update(keys[depth - 1].encode() + b"\n")
        out.append(running.hexdigest())
    return out


def local_nodes(sequences: list[list[str]], words: list[list[int]], low: np.ndarray, members: np.ndarray, ends: list[str], shared_before: int, shared_after: int) -> dict:
    """The nodes of sorted distinct sequences. ``shared_before`` and ``shared_after`` are the common prefix lengths with the
    sequence before the first and after the last of them, -1 if there is none."""
    n = len(sequences)
    length = np.array([len(s) for s in sequences], np.int64)
    lcp = np.array([-1, *(common_prefix(a, b) for a, b in zip(sequences, sequences[1:]))], np.int64)
    base = np.concatenate([[0], np.cumsum(length + 1)])[:-1]  # running tokens of row x up to depth d: upto[base[x] + d]
    upto = np.concatenate([np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words])
    whole = upto[base + length]

    fresh = length - lcp  # candidates of a row: the prefixes that the row before does not have
    first_node = np.cumsum(fresh) - fresh
    row = np.repeat(np.arange(n), fresh)
    depth = np.arange(len(row)) - first_node[row] + lcp[row] + 1
    minima = sparse_minima(lcp)
    last = right_ends(minima, row, depth)
    above = np.maximum(depth - 1, 0)
    parent_row = left_ends(minima, row, above)
    parent = first_node[parent_row] + above - lcp[parent_row] - 1

    def between(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last + 1] - sums[row]

    n_convs = between(members)
    follows = np.concatenate([lcp[1:], [shared_after]])  # a row is no leaf if the next one goes on from it
    told = np.maximum(lcp, 0)  # depth up to which a row's tokens are counted by a row before it
    told[0] = max(shared_before, 0)
    own_from = np.maximum(above, np.where(row == 0, told[0], 0))
    counted = between(whole - upto[base + told]) - (whole - upto[base + told])[row] + (whole[row] - upto[base[row] + np.minimum(own_from, length[row])])
    saved = between(members * whole) - n_convs * upto[base[row] + above] - counted
    repeated = (row == 0) & (depth <= shared_before)  # nodes that a partition before has as well
    is_child = (depth > 0) & ~repeated
    crossing = repeated | ((last == n - 1) & (depth <= shared_after))
    low_id = range_minima(sparse_minima(low), row, last)

    edge = [_prefix_digests(sequences[0], shared_before if shared_before > 0 else 0), _prefix_digests(sequences[-1], max(shared_after, 0))]
    key = np.full(len(row), None, object)
    for k in np.flatnonzero(crossing):
        key[k] = edge[0][depth[k]] if repeated[k] else edge[1][depth[k]]
    open_parent = (depth > 0) & crossing[parent]
    ended = np.full(len(row), None, object)
    ended[first_node + fresh - 1] = ends
    return {
        "depth": depth,
        "conv_id": low_id,
        "key": key,
        "parent_conv_id": np.where((depth > 0) & ~open_parent, low_id[parent].astype(object), None),
        "parent_key": np.where(open_parent, key[parent], None),
        "n_convs": n_convs,
        "n_children": np.bincount(parent[is_child], minlength=len(row)),
        "n_leaves": between(follows < length),
        "saved_tokens": saved,
        "ends_sha256": ended,
    }


def ids_digests(members: DataFrame, key: str, id_col: str) -> DataFrame:
    """``key`` and ``ends_sha256``: the SHA-256 of its ids, ascending and joined by commas.

    Sorted ids are joined into pieces of bounded size in all tasks, also those of one hot key; the pieces of a key then stream
    through one digest, which is sequential by nature.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            starts = [at for a, b in zip(starts, [*starts[1:], len(keys)]) for at in range(a, b, CHUNK_IDS)]
            joined = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays([pa.array([v[a] for a in starts], t) for v, t in ((keys, pa.string()), (places, pa.int64()))] + [pa.array(joined, pa.string())], names=[key, "_at", "_ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(key).to_pylist(), batch.column("_ids").to_pylist()):
                if name == current:
                    running.update(b"," + ids.encode())
                else:
                    if current is not None:
                        done.append((current, running.hexdigest()))
                    current, running = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=[key, "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([running.hexdigest()])], names=[key, "ends_sha256"])

    # partitions of a range sort are in order, and so are the ids of their rows
    ranged = members.select(key, id_col).repartitionByRange(key, id_col).sortWithinPartitions(key, id_col)
    joined = ranged.withColumn("_at", F.monotonically_increasing_id()).mapInArrow(pieces, f"{key} string, _at long, _ids string")
    return joined.repartition(key).sortWithinPartitions(key, "_at").mapInArrow(digests, f"{key} string, ends_sha256 string")


def build_trie(conversations: DataFrame) -> DataFrame:
    """One row a distinct prefix of ``conversations (conv_id long, turns array<struct<key: string, words: long>>)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``, as stated in the contract. Equal keys mean equal turns. Conversations have unique ids; a null id or null
    turns is left out. An empty table has no nodes, not even a root. One conversation is one row, 48 bytes a turn.
    """
    rows = conversations.filter("conv_id IS NOT NULL AND turns IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turns", F.transform("turns", lambda t: t["key"]).alias("keys")
    )
    rows = materialise(rows.withColumn("seq", F.sha2(F.array_join("keys", "\n"), 256)), "conversations")
    groups = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("conv_id"))
    groups = groups.join(ids_digests(rows, "seq", "conv_id"), "seq")
    # the ids are unique, so this join deals the rows of one sequence out as well
    distinct = rows.join(groups, ["conv_id", "seq"]).select("keys", F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id", "members", "ends_sha256")
    ordered = distinct.repartitionByRange("keys").sortWithinPartitions("keys")
    table = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "sorted_conversations")
    numbers = sorted(r[0] for r in table.select("_part").distinct().collect())  # one row a partition
    spark = conversations.sparkSession
    border = spark.createDataFrame(list(zip(numbers, numbers[1:])), "_part long, _next long")
    firsts = table.groupBy("_part").agg(F.min_by("keys", "_at").alias("after"))
    lasts = table.groupBy("_part").agg(F.max_by("keys", "_at").alias("before"))
    pairs = lasts.join(F.broadcast(border), "_part").join(firsts.withColumnRenamed("_part", "_next"), "_next")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [common_prefix(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_part"), batch.column("_next"), pa.array(shared, pa.int64())], names=["_part", "_next", "shared"])

    shared = pairs.select("_part", "_next", "before", "after").mapInArrow(measure, "_part long, _next long, shared long").collect()  # one row a border
    after, before = {r[0]: r[2] for r in shared}, {r[1]: r[2] for r in shared}

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        number = part.column("_part")[0].as_py()
        nodes = local_nodes(
            part.column("keys").to_pylist(),
            part.column("words").to_pylist(),
            part.column("conv_id").to_numpy(),
            part.column("members").to_numpy(),
            part.column("ends_sha256").to_pylist(),
            before.get(number, -1),
            after.get(number, -1),
        )
        text = {"key", "parent_key", "ends_sha256"}
        return pa.table({c: pa.array(v, pa.string() if c in text else pa.int64()) for c, v in nodes.items()})

    nodes = materialise(table.groupBy("_part").applyInArrow(build, _NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), *sums, F.max("ends_sha256").alias("ends_sha256")
    )
    opened = materialise(opened, "open_nodes")
    every = nodes.filter("key IS NULL").drop("key").unionByName(opened.drop("key"), allowMissingColumns=True)
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"), F.col("n_children").alias("_rows"))
    named = attach_facts(every, parents, ["parent_key"], F.col("_rows"), "conv_id", keep_unmatched=True)
    return named.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
