"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, its documents in order of id, are one stream that starts again at its end; it is cut into blocks of
``block`` words. Targets follow the weights, but stop at ``most`` times a source's words. The blocks of the whole mix are awarded one
by one to the source with the highest quotient ``target / (2 * awarded + 1)``, and every shard takes the next equal share of the
awards: integer quotas per source and shard, proportional in each shard and in each run of shards. A source's awarded blocks are
chosen by a seeded permutation of the blocks of each pass over it, all of a pass before any of the next, so that no word is taken
``most + 1`` times and no document more often than it should.

Nothing here depends on the number of sources being small: the award order is cut by counting how many quotients lie above
a threshold, in every task, and ranking the few around it. Documents learn their blocks from their place in the stream alone, so blocks
are never rows and texts are never moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.llm.texts import map_rows, mix64
from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import global_rank, rank_within
from silverprint.workspace import materialise

#: Words of a block, and shards of a mix.
BLOCK_WORDS = 32
SHARDS = 16

_GRID = 64  # thresholds tried at once for each shard


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text of a string column; null has none."""
    large = column.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    if not len(large) or offsets[-1] == offsets[0]:
        return np.zeros(len(large), np.int64)
    data = np.frombuffer(large.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    solid = (data != 32) & ((data < 9) | (data > 13))
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1] - offsets[0]
    edges = first[(first > 0) & (first < len(data))]
    starts[edges] = solid[edges]  # a text does not go on from the one before
    sums = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    counts = sums[offsets[1:] - offsets[0]] - sums[first]
    return np.where(large.is_null().to_numpy(zero_copy_only=False), 0, counts)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col``, ``source`` and ``size``, the words of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = pa.array(word_counts(batch.column(2)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[id_col, "source", "size"])

    three = docs.select(id_col, F.col(source_col).cast("string").alias("source"), text_col)
    return map_rows(three, work, f"`{id_col}` {three.schema[id_col].dataType.simpleString()}, source string, size long", text_col)


def _key(source) -> F.Column:
    """Sources as keys that are never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def with_targets(sources: DataFrame, wanted: float, most: float) -> DataFrame:
    """``target``: ``wanted`` words shared by ``weight``, none above ``most * size``; what is cut off is shared again."""
    limit = most * F.col("size")
    level, capped = 0.0, -1
    while True:
        # words a unit of weight gets, if the sources that this level fills up stop at their limit
        full = limit < level * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).head()
        if row[2] == capped or not row[1]:
            break
        level, capped = max(level, (wanted - row[0]) / row[1]), row[2]
    return sources.withColumn("target", F.least(limit, level * F.col("weight")).cast("double"))


def _seats(target: np.ndarray, cap: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Awards of each source (rows) whose quotient is at least the level (columns)."""
    return np.minimum(np.floor((target[:, None] / level[None, :] + 1) / 2), cap[:, None]).astype(np.int64)


def quotas(sources: DataFrame, blocks: int, shards: int) -> DataFrame:
    """``sources (key, target, cap)`` with ``upto``: its blocks in the first 1, 2, ... ``shards`` shards of a mix of ``blocks``.

    For each shard border the quotient is narrowed down between two levels, by counts summed over all tasks, until about
    as many awards as there are sources lie between them; these are ranked by quotient, ties by key. ``blocks`` is at most
    the sum of the caps.
    """
    spark = sources.sparkSession
    goals = np.array([(k + 1) * blocks // shards for k in range(shards)])
    few = sources.select("key", "target", "cap")
    n, total, top = few.filter("cap > 0 AND target > 0").agg(F.count(F.lit(1)), F.sum("target"), F.max("target")).head()
    if not n or not blocks:
        return few.select("key", F.array_repeat(F.lit(0).cast("long"), shards).alias("upto"))

    def counted(levels: np.ndarray) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(levels.size, np.int64)
            for batch in batches:
                target, cap = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for at in range(0, len(target), 1_000):
                    sums += _seats(target[at : at + 1_000], cap[at : at + 1_000], levels.ravel()).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(levels.size)), pa.array(sums)], names=["at", "seats"])

        found = few.select("target", "cap").mapInArrow(count, "at long, seats long").groupBy("at").agg(F.sum("seats")).collect()
        out = np.zeros(levels.size, np.int64)
        for at, seats in found:  # one row a shard and level
            out[at] = seats
        return out.reshape(levels.shape)

    high = np.where(2 * goals > n, total / np.maximum(2 * goals - n, 1) * (1 + 1e-9), 2.0 * top)
    low = total / (2 * goals + 2 * n)
    taken = np.zeros(shards, np.int64)  # awards at the high level
    for _ in range(40):
        grid = np.geomspace(high, low, _GRID, axis=1)
        grid[:, 0], grid[:, -1] = high, low
        counts = counted(grid)
        rows = np.arange(shards)
        below = (counts <= goals[:, None]).sum(1) - 1  # the lowest level with not too many awards
        high, taken = grid[rows, below], counts[rows, below]
        short = counts[:, -1] < goals  # the caps leave fewer than the bound: go lower
        after = np.minimum(below + 1, _GRID - 1)
        spread = np.where(short, np.iinfo(np.int64).max, counts[rows, after] - taken)
        low = np.where(short, low / 64, grid[rows, after])
        if (spread <= 2 * n + 16).all() or (np.abs(high - low) <= 4e-16 * high).all():
            break

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                piece = batch.slice(at, 1_000)
                target, cap = piece.column(1).to_numpy(), piece.column(2).to_numpy()
                sure, least = _seats(target, cap, high), _seats(target, cap, low)
                picks = [[list(range(a, b)) for a, b in zip(x, y)] for x, y in zip(sure.tolist(), least.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(sure.tolist(), pa.list_(pa.int64())), pa.array(picks, pa.list_(pa.list_(pa.int64())))],
                    names=["key", "target", "sure", "picks"],
                )

    near = materialise(few.mapInArrow(around, "key string, target double, sure array<long>, picks array<array<long>>"), "quotients")
    each = near.select("key", "target", F.posexplode("picks").alias("shard", "seats")).select("key", "target", "shard", F.explode("seats").alias("seat"))
    quotient = each.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    ranked = rank_within(quotient, ["shard"], [F.col("quotient").desc(), F.col("key"), F.col("seat")], "place")
    room = spark.createDataFrame([(k, int(g - t)) for k, (g, t) in enumerate(zip(goals, taken))], "shard int, room long")
    won = ranked.join(F.broadcast(room), "shard").filter("place <= room").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("won"))
    extra = won.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("shard", "won"))).alias("extra"))  # one entry a shard
    upto = F.transform("sure", lambda sure, k: sure + F.coalesce(F.try_element_at(F.col("extra"), k), F.lit(0)))
    return near.select("key", "sure").join(extra, "key", "left").select("key", upto.alias("upto"))


def permuted(at: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The place of ``at`` in a seeded permutation of ``range(n)``, each with its own ``n`` and seed: a Feistel network on the
    next even power of two, walked until it is back in range."""
    out = at.astype(np.uint64)
    n, seed = n.astype(np.uint64), seed.astype(np.uint64)
    half = np.maximum((np.frexp(np.maximum(n.astype(float) - 1, 1))[1] + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            mixed = mix64(right + seed[todo] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def taken_pieces(first: np.ndarray, size: np.ndarray, stream: np.ndarray, upto: np.ndarray, seed: np.ndarray, block: int, most: float) -> dict:
    """What the mix takes of documents at ``first`` in their source's ``stream`` words: row, shard, first word, words of each piece."""
    rows, shard, start, words = [], [], [], []
    limit = np.floor(most * stream / block).astype(np.int64)  # blocks there are in all passes
    for turn in range(math.ceil(most)):
        begin, next_pass = turn * stream + first, (turn + 1) * stream // block
        low, high = begin // block, np.minimum((begin + size - 1) // block, limit - 1)
        count = np.where((size > 0) & (upto[:, -1] > turn * stream // block), np.maximum(high - low + 1, 0), 0)
        row = np.repeat(np.arange(len(first)), count)
        if not len(row):
            continue
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        # the block across the end of a pass is the first of the next
        own = np.where(number >= next_pass[row], turn + 1, turn)
        base = own * stream[row] // block
        after = np.minimum((own + 1) * stream[row] // block, limit[row])
        place = base + permuted(number - base, after - base, seed[row] + own.astype(np.uint64))
        chosen = np.flatnonzero(place < upto[row, -1])
        row, number, place = row[chosen], number[chosen], place[chosen]
        a = np.maximum(number * block, begin[row]) - begin[row]
        b = np.minimum((number + 1) * block, begin[row] + size[row]) - begin[row]
        rows.append(row)
        shard.append((upto[row] <= place[:, None]).sum(1))
        start.append(a)
        words.append(b - a)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return {"row": join(rows), "shard": join(shard), "start": join(start), "words": join(words)}


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``pieces`` (shard, first word, words) of every document.

    ``weights (source, weight)`` has one row a source; a source without one gets nothing. The mix has ``share`` times all words,
    at most ``most`` times those of each source; what a source takes differs from its target by the rounding of the awards to
    whole blocks. Null texts have no words and give none. The null source is a source of its own. Rows that agree in source, id and size
    are taken in any order: the table of results is the same. Ids may be null or repeat; other columns are left out. An empty table
    gives an empty table.
    """
    measured = sized(docs, id_col, source_col, text_col).withColumn("_key", _key(F.col("source")))
    placed = global_rank(measured, [F.col("_key"), F.col(id_col), F.col("size")], "_rank", {"_upto": "size"}).drop("_rank")
    placed = placed.withColumn("_start", F.col("_upto") - F.col("size")).drop("_upto")
    found = placed.groupBy("_key").agg(F.sum("size").alias("size"), F.min("_start").alias("begin"), F.count(F.lit(1)).alias("rows"))
    weighed = weights.select(_key(F.col("source")).alias("_key"), F.col("weight").cast("double").alias("weight"))
    sources = materialise(found.join(weighed, "_key", "left").fillna(0.0, ["weight"]).withColumnRenamed("_key", "key"), "sources")
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    aimed = materialise(
        with_targets(sources, share * total, most).withColumn("cap", F.when(F.col("target") > 0, F.floor(most * F.col("size") / block)).otherwise(F.lit(0)).cast("long")), "targets"
    )
    # a full source ends with its last whole block; what is left of it goes to nobody else
    blocks = round(aimed.agg(F.coalesce(F.sum(F.least(F.col("target") / block, F.col("cap").cast("double"))), F.lit(0.0))).head()[0])
    facts = aimed.join(quotas(aimed, blocks, shards), "key").select(
        F.col("key").alias("_key"), F.col("size").alias("source_size"), "target", "begin", "rows", "upto", F.xxhash64("key", F.lit(seed)).alias("salt")
    )
    joined = attach_facts(placed, facts, ["_key"], F.col("rows"), id_col).withColumn("first", F.col("_start") - F.col("begin"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = lambda c: batch.column(c).to_numpy()
        upto = batch.column("upto").flatten().to_numpy().reshape(-1, shards)
        got = taken_pieces(number("first"), number("size"), number("source_size"), upto, number("salt").view(np.uint64), block, most)
        order = np.lexsort((got["start"], got["shard"], got["row"]))
        ends = np.searchsorted(got["row"][order], np.arange(batch.num_rows + 1))
        piece = pa.StructArray.from_arrays([pa.array(got[c][order].astype(np.int64)) for c in ("shard", "start", "words")], ["shard", "first", "words"])
        taken = np.bincount(got["row"], got["words"], batch.num_rows).astype(np.int64)
        same = [batch.column(c) for c in (id_col, "source", "size", "source_size", "target")]
        pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), piece)
        return pa.RecordBatch.from_arrays([*same, pa.array(taken), pieces], names=[id_col, "source", "size", "source_size", "target", "taken", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                yield work(batch.slice(at, 1_000))

    kind = placed.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, source string, size long, source_size long, target double, taken long, pieces array<struct<shard:long,first:long,words:long>>"
    return joined.select(id_col, "source", "size", "source_size", "target", "first", "upto", "salt").mapInArrow(run, schema)
