"""Token files in Simple-8b: 64-bit words that each say how many ids they hold.

The top four bits of a word are its selector, the other sixty hold a fixed number of ids of equal width, the first id in
the lowest bits. A value of more than sixty bits is escaped: a word with selector ``ESCAPE`` and then the value itself.
Ids come in blocks of ``BLOCK`` ids with the word offset of each block kept beside them, so that blocks are coded and
decoded side by side.

A token file is a Parquet table of chunks. A chunk holds whole documents, in ascending order of their ids, of about
``CHUNK`` ids: its words, block offsets, document ids and lengths. Chunks are numbered within a shard and shards follow one
another in the order of document ids, so the place of every id is known from the chunk counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silverprint.llm.byte_bpe import Encoder
from silverprint.llm.texts import slices

BLOCK = 1024
CHUNK = 1 << 18
#: Ids of a word and bits of each, by selector; from selector 2 on the densest that fits is taken.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
CHUNKS = "shard long, chunk long, n_ids long, words binary, offsets array<int>, doc_ids array<long>, lengths array<long>"


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word offset of every block. All blocks advance together, a word at a step."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int32)
    # the densest selector at each place; a window that would leave the block is refused
    room = np.minimum(block - np.arange(n) % block, n - np.arange(n))
    best = np.full(n, ESCAPE, np.uint8)
    peak, size = values, 1
    peaks = {1: values}
    while size < 60:
        peak = np.maximum(peak, np.append(peak[size:], np.zeros(min(size, n), np.uint64))[:n])
        size *= 2
        peaks[size] = peak
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[selector]
        power = 1 << (count.bit_length() - 1)
        rest = count - power
        top = peaks[power]
        if rest:
            top = np.maximum(top, np.append(top[rest:], np.zeros(min(rest, n), np.uint64))[:n])
        best[(room >= count) & (top < np.uint64(1 << bits))] = selector
    counts = np.array([c for c, _ in SELECTORS] + [0, 1], np.int64)
    lanes = np.arange(0, n, block)
    ends = np.minimum(lanes + block, n)
    at, steps = lanes.copy(), []
    while len(live := np.flatnonzero(at < ends)):
        steps.append((live, at[live]))
        at[live] += counts[best[at[live]]]
    lane = np.concatenate([s[0] for s in steps])
    begin = np.concatenate([s[1] for s in steps])
    order = np.argsort(begin)
    lane, begin = lane[order], begin[order]
    chosen = best[begin]
    escaped = chosen == ESCAPE
    places = np.arange(len(begin)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(begin) + escaped.sum(), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            slots = values[begin[rows][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[places[rows]] = np.bitwise_or.reduce(slots, axis=1) | np.uint64(selector << 60)
    words[places[escaped]] = np.uint64(ESCAPE << 60)
    words[places[escaped] + 1] = values[begin[escaped]]
    offsets = places[np.searchsorted(lane, np.arange(len(lanes)))]
    return words, np.append(offsets, len(words)).astype(np.int32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of one or more whole blocks."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0, 0], np.int64)[selectors]
    counts[raw] = 1
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero((selectors == selector) & ~raw)
        if len(rows):
            slots = words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
            out[starts[rows][:, None] + np.arange(count)] = slots
    out[starts[raw]] = words[raw]
    return out


def _chunk(shard: int, number: int, doc_ids: list, rows: list[np.ndarray]) -> dict:
    ids = np.concatenate(rows)
    words, offsets = pack(ids)
    return {"shard": shard, "chunk": number, "n_ids": len(ids), "words": words.astype("<u8").tobytes(), "offsets": offsets.tolist(), "doc_ids": doc_ids, "lengths": [len(r) for r in rows]}


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write a token file at ``path`` in ascending order of ``doc_id``.

    Null and empty texts hold the end id alone, documents without id come first, repeated ids stand in order of their text.
    """
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("offsets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        shard, number, held, doc_ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in (piece for whole in batches for piece in slices(whole)):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            for key, row in zip(batch.column("id").to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                held.append(np.append(row, np.uint32(end_id)))
                doc_ids.append(key)
                size += len(held[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_pylist([_chunk(shard, number, doc_ids, held)], schema)
                    number, held, doc_ids, size = number + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_chunk(shard, number, doc_ids, held)], schema)

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(write, CHUNKS).write.option("compression", "zstd").parquet(path)


def chunk_starts(file: DataFrame) -> DataFrame:
    """Number of ids before each shard; one row a shard, of which there are as many as the writing job had tasks."""
    shards = file.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the file, or their CRC-32 as ``ids_crc32``."""
    file = spark.read.schema(CHUNKS).parquet(path)
    chunk_base = Window.partitionBy("shard").orderBy("chunk")
    inner = file.select("shard", "chunk", "n_ids").withColumn("chunk_start", F.sum("n_ids").over(chunk_base) - F.col("n_ids"))
    kind = pa.list_(pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = zip(row["offsets"], row["offsets"][1:])
                words = np.frombuffer(row["words"], "<u8")
                ids = np.concatenate([np.empty(0, np.uint64), *(unpack(words[a:b]) for a, b in blocks)]) if not digest else unpack(words)
                ends = np.cumsum(row["lengths"])
                texts = np.split(ids, ends[:-1])
                n = len(texts)
                value = (
                    pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in texts], pa.int64())
                    if digest
                    else pa.array([t.astype(np.int64) for t in texts], kind)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int64()), pa.array([row["chunk"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()), value],
                    ["shard", "chunk", "doc_id", "within", "n_tokens", "ids"],
                )

    docs = file.mapInArrow(read, f"shard long, chunk long, doc_id long, within long, n_tokens long, ids {'long' if digest else 'array<long>'}")
    starts = inner.join(F.broadcast(chunk_starts(file)), "shard").select("shard", "chunk", (F.col("before") + F.col("chunk_start")).alias("base"))
    return docs.join(starts, ["shard", "chunk"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids")
    )
