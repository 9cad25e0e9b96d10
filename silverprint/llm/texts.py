"""Words, word hashes and Arrow batches shared by the operators of this package.

``content_words`` are the runs of lower-cased ASCII letters, digits and code points from 0x80 on;
``plain_words`` are the runs of anything but ASCII white space, with A-Z lower-cased. Both work on UTF-8
bytes, where every byte of a code point from 0x80 on is itself 0x80 or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CONTENT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)
#: Text of this many bytes is worked on at once; a longer text is one slice of its own.
SLICE_BYTES = 1 << 20


def content_words(text: bytes | None) -> list[bytes]:
    return text.translate(_CONTENT).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def content_spans(text: bytes) -> np.ndarray:
    """First and past-the-end byte of every content word, one row a word."""
    inside = np.frombuffer(text.translate(_CONTENT), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size_by: str = "text") -> DataFrame:
    """``df.mapInArrow`` that hands on slices whose ``size_by`` column holds about ``SLICE_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size_by):
                yield work(piece)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size_by: str = "text") -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(size_by)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order says nothing about their origin."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eight_bytes(buffer: bytes) -> np.ndarray:
    """The eight bytes from every place of a buffer on as one number, zeros behind its end."""
    padded = buffer + bytes(8)
    return np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))


def _first_bytes(numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Only the first ``count`` bytes of each number, the others zero."""
    left = np.clip(count, 0, 8).astype(np.uint64)
    mask = np.where(left < 8, (np.uint64(1) << (left % np.uint64(8) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
    return numbers & mask


class SpanHasher:
    """64-bit hashes of many byte spans of one buffer at once: eight bytes are mixed in at a step, so that the hash of a span
    depends on nothing but its bytes and on each of them in its place. Spans of more than ``LONG`` bytes are digested singly."""

    LONG = 64

    def hashes(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        numbers, lengths = _eight_bytes(buffer), ends - starts
        out = mix64(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, done = np.flatnonzero(lengths <= self.LONG), 0
        while len(live := live[lengths[live] > done]):
            part = _first_bytes(numbers[starts[live] + done], lengths[live] - done)
            out[live] = mix64(out[live] ^ part)
            done += 8
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            digest = hashlib.blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out


def chained(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each run of ``count`` hashes from ``first`` on; order and number of them matter."""
    out = mix64(count.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        out[live] = mix64(out[live] ^ hashes[first[live] + step])
    return out


def distinct_spans(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each span among the distinct ones, and the index of the first span of each number. Exact: up to 16 bytes are
    compared as two numbers, longer spans by their bytes."""
    numbers, lengths = _eight_bytes(buffer), ends - starts
    head = _first_bytes(numbers[starts], lengths)
    tail = _first_bytes(numbers[np.minimum(starts + 8, len(buffer))], lengths - 8)
    kind, table = lengths.copy(), {}
    for i in np.flatnonzero(lengths > 16).tolist():
        head[i], tail[i], kind[i] = table.setdefault(buffer[starts[i] : ends[i]], len(table)), 0, 17
    keys = mix64(mix64(head) + tail * np.uint64(0x9E3779B97F4A7C15) + kind.astype(np.uint64))
    order, found = pd.factorize(keys)
    where = np.empty(len(found), np.int64)
    where[order[::-1]] = np.arange(len(order))[::-1]
    at = where[order]
    if not ((head == head[at]) & (tail == tail[at]) & (kind == kind[at])).all():  # two keys agree by chance
        seen: dict = {}
        order = np.array([seen.setdefault(buffer[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
        where = np.unique(order, return_index=True)[1]
    return order, where
