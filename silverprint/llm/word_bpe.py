"""BPE encoding and decoding through a table of distinct words.

Texts are split into words at white space. The tokenizer drops white space and merges nothing across it, so the ids of a
text are the ids of its words in order (tests compare with the library on whole texts).

1. Documents are taken in blocks of about ``BLOCK_BYTES`` of text. A block cuts its distinct words further where the
   tokenizer cuts in any case, numbers the distinct parts by frequency and keeps each document as the numbers of its
   parts, a byte or two each. Below, a word is such a part.
2. The blocks' words are shuffled by word and sorted, so every distinct word of the input is encoded once, in one task,
   and its ids go back to each block that asked. A word is asked for once a block, so none is hot.
3. Each block joins ids back by position, and ids to pieces through the vocabulary, which is broadcast (it is of fixed
   size).

No text is shuffled: what moves is each block's distinct words, their ids and the packed word numbers. The blocks are
made twice, once for the words and once for the documents, so the input must read the same both times: other inputs
than stored tables are written first.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.llm.texts import as_bytes
from silverprint.workspace import materialise

#: Text of one block; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file without truncation and padding, once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


_ASCII_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_SIGNS = r"([!-/:-@\[-`{-~]*)"
_LETTERS = re.compile(rf"{_SIGNS}([^\W\d_]+){_SIGNS}")


def _width(model) -> str:
    return "<u2" if model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of the stretches of these sizes begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def pack_stretches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Stretches of unsigned numbers below 2^28 as one to four bytes each, seven bits a byte, low ones first."""
    values = values.astype(np.uint32)
    places = offsets_of(1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21))
    width, starts = np.diff(places), places[:-1]
    out = np.empty(places[-1], np.uint8)
    for i in range(4):
        has = width > i
        more = (width[has] > i + 1).astype(np.uint8) << 7
        out[starts[has] + i] = (values[has] >> np.uint32(7 * i)).astype(np.uint8) & 127 | more
    packed, cuts = out.tobytes(), places[offsets].tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def unpack_stretches(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all stretches, and the offsets of the stretches."""
    raw = np.frombuffer(b"".join(packed), np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for i in range(4):
        has = starts + i <= ends
        out[has] |= (raw[starts[has] + i].astype(np.int64) & 127) << (7 * i)
    return out, offsets_of(last)[offsets_of([len(p) for p in packed])]


def pack_numbers(values: np.ndarray) -> bytes:
    return pack_stretches(values, np.array([0, len(values)]))[0]


def unpack_numbers(packed: bytes) -> np.ndarray:
    return unpack_stretches([packed])[0]


def gathered(offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of everything in the chosen stretches, one stretch after the other."""
    n = np.diff(offsets)[chosen]
    return np.repeat(offsets[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def parts_of(word: bytes) -> list[bytes]:
    """A word cut where the pre-tokenizer cuts in any case: letters, single digits and other signs stand apart.

    A word of ASCII is cut wholly and lower-cased, as the tokenizer does. Of other words only ASCII signs around letters are
    taken off. Words that hold an apostrophe (contractions) or may hold a special token stay whole.
    """
    if word.isalpha():  # ASCII letters only
        return [word.lower()]
    if b"'" in word or b"<|" in word:
        return [word]
    if word.isascii():
        return _ASCII_PARTS.findall(word.lower())
    match = _LETTERS.fullmatch(word.decode())
    # lower-casing may end a letter with a mark, which joins the signs after it
    return [p.encode() for p in match.groups() if p] if match and match.group(2).lower().isalpha() else [word]


class _Block:
    """Documents of about ``BLOCK_BYTES`` of text as word numbers; words are numbered as they come."""

    def __init__(self, key: int, split: Callable[[bytes], list[bytes]] = bytes.split):
        self.key, self.size, self.split = key, 0, split
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.texts: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch, texts: list[bytes | None]) -> None:
        number = self.numbers.__getitem__
        for text in texts:
            words = self.split(text) if text else []
            self.texts.append(np.array(list(map(number, words)), np.int32))
            self.size += len(text or b"")
        self.rows.append(rows)

    def ranked(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct parts of the words by falling frequency; numbers of the parts of all words, with the words' offsets."""
        parts: defaultdict[bytes, int] = defaultdict()
        parts.default_factory = parts.__len__
        flat, lengths = array("i"), array("i")
        for word in self.numbers:
            cut = parts_of(word)
            lengths.append(len(cut))
            flat.extend(map(parts.__getitem__, cut))
        flat, lengths = np.array(flat, np.int64), np.array(lengths, np.int64)
        uses = np.bincount(np.concatenate([np.empty(0, np.int32), *self.texts]), minlength=len(lengths))
        order = np.argsort(-np.bincount(flat, np.repeat(uses, lengths), minlength=len(parts)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = list(parts)
        return [words[i] for i in order.tolist()], place[flat], offsets_of(lengths)


def blocks(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], split: Callable[[bytes], list[bytes]] = bytes.split) -> Iterator[_Block]:
    """Blocks numbered across all tasks, the same whenever the same rows are read.

    A block ends with the row that fills it. Where Arrow batches end, which depends on the columns read, makes no difference.
    """
    task = TaskContext.get().partitionId()
    block = _Block(task << 32, split)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            texts = as_bytes(piece.column(text))
            start, size = 0, block.size
            for end, raw in enumerate(texts, 1):
                size += len(raw or b"")
                if size >= BLOCK_BYTES:
                    block.add(piece.slice(start, end - start).select(kept), texts[start:end])
                    yield block
                    block = _Block(block.key + 1, split)
                    start, size = end, 0
            if start < len(texts):
                block.add(piece.slice(start).select(kept), texts[start:])
    if block.texts:
        yield block


def _word_rows(docs: DataFrame, text: str) -> DataFrame:
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, []):
            words, _, _ = block.ranked()
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block.key)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary())],
                    ["block", "number", "word"],
                )

    return docs.select(text).mapInArrow(words_of, "block long, number int, word binary")


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """The ids of each (block, number); rows come sorted by word, each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        width = _width(model)
        last_word, last_ids = None, b""
        for batch in batches:
            rows = batch.column("word").to_pylist()
            fresh = [w for w, before in zip(rows, [last_word, *rows]) if w != before]
            coded = model.encode_batch([w.decode() for w in fresh], add_special_tokens=False)
            made = iter([np.array(e.ids, width).tobytes() for e in coded])
            out = []
            for word in rows:
                if word != last_word:
                    last_word, last_ids = word, next(made)
                out.append(last_ids)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("number"), pa.array(out, pa.binary())], ["block", "number", "ids"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block long, number int, ids binary")


def _doc_rows(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_numbers", T.BinaryType()), *docs.select(kept).schema.fields])

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, kept):
            _, numbers, offsets = block.ranked()
            at = 0
            for rows in block.rows:
                texts = block.texts[at : at + rows.num_rows]
                codes = np.concatenate(texts)
                ends = offsets_of(np.diff(offsets)[codes])[offsets_of([len(t) for t in texts])]
                parts = pack_stretches(numbers[gathered(offsets, codes)], ends)
                at += rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), block.key)), pa.array(parts, pa.binary()), *rows.columns], schema.names)

    return docs.select(*kept, *([] if text in kept else [text])).mapInArrow(docs_of, schema)


def _with_ids(docs: DataFrame, path: str, text: str, kept: list[str], fields: list[T.StructField], columns: Callable[..., list[pa.Array]], stored: bool) -> DataFrame:
    """``kept`` columns of ``docs`` and those that ``columns`` makes of a block: the ids of its words with their offsets, its
    documents' word numbers with theirs, and the pieces as bytes behind a space."""
    if not stored:
        docs = materialise(docs, "docs")
    model = tokenizer(path)
    vocabulary = {i: piece for piece, i in model.get_vocab(with_added_tokens=True).items()}
    pieces = docs.sparkSession.sparkContext.broadcast([f" {vocabulary.get(i, '')}".encode() for i in range(max(vocabulary) + 1)])
    width = _width(model)
    schema = T.StructType([*docs.select(kept).schema.fields, *fields])

    def join(key: tuple, rows: pa.Table, ids: pa.Table) -> pa.Table:
        order = np.argsort(ids.column("number").to_numpy())
        of_word = ids.column("ids").combine_chunks().take(pa.array(order)).to_pylist()
        flat = np.frombuffer(b"".join(of_word), width)
        starts = offsets_of([len(w) // flat.itemsize for w in of_word])
        made = columns(flat, starts, *unpack_stretches(rows.column("_numbers").to_pylist()), pieces.value)
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *made], names=schema.names)

    ids = _encoded(_word_rows(docs, text), path)
    return _doc_rows(docs, text, kept).groupBy("_block").cogroup(ids.groupBy("block")).applyInArrow(join, schema)


def encode(docs: DataFrame, path: str, text: str = "text", stored: bool = False) -> DataFrame:
    """``docs`` with the column ``ids``; null and empty texts have no ids, an old ``ids`` is replaced.

    ``stored=True`` says that ``docs`` is a plain read of a stored table, which need not be written first.
    """

    def ids_of(ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray, offsets: np.ndarray, pieces: list) -> list[pa.Array]:
        ends = offsets_of(np.diff(starts)[numbers])[offsets]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[gathered(starts, numbers)].astype(np.int32)))]

    kept = [c for c in docs.columns if c != "ids"]
    return _with_ids(docs.select(kept), path, text, kept, [T.StructField("ids", T.ArrayType(T.IntegerType()))], ids_of, stored)


def decode(rows: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with their ids joined to pieces, which are joined by a space as the library does without a decoder."""
    model = tokenizer(path)
    pieces = rows.sparkSession.createDataFrame(sorted((i, p) for p, i in model.get_vocab(with_added_tokens=True).items()), "id int, piece string")
    keyed = rows.drop(column).withColumn("_row", F.monotonically_increasing_id())
    stored = materialise(keyed, "ids")
    at = stored.select("_row", F.posexplode(ids).alias("at", "id")).join(F.broadcast(pieces), "id")  # the vocabulary is of fixed size
    texts = at.groupBy("_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p.piece), " ").alias(column))
    return stored.join(texts, "_row", "left").select(*[c for c in stored.columns if c != "_row"], F.coalesce(column, F.lit("")).alias(column))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, null as empty.

    Ids are written in decimal and joined by a space, pieces are joined by a space as the library's ``decode`` does.
    Repeated documents and those without id each get their row.
    """

    def digest(ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray, offsets: np.ndarray, pieces: list[bytes]) -> list[pa.Array]:
        counts = np.diff(offsets_of(np.diff(starts)[numbers])[offsets])
        cuts, bounds, tokens = starts.tolist(), offsets.tolist(), ids.tolist()

        def digested(of: list[bytes]) -> list[str]:
            shown = list(map(of.__getitem__, tokens))
            # a word without ids (nothing but characters that are dropped) must leave no space behind
            words = [shown[a] if b == a + 1 else b"".join(shown[a:b]) for a, b in zip(cuts, cuts[1:])]
            rows = (map(words.__getitem__, numbers[a:b].tolist()) for a, b in zip(bounds, bounds[1:]))
            return [hashlib.sha256(b"".join(row)[1:]).hexdigest() for row in rows]

        decimal = [b" %d" % i for i in range(len(pieces))]
        return [pa.array(counts, pa.int64()), pa.array(digested(decimal), pa.string()), pa.array(digested(pieces), pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _with_ids(source, path, "text", ["doc_id"], fields, digest, stored)
