"""Cross-entropy difference: two bigram models over the words of the corpus, and what each word costs under either.

Both models have the same order, smoothing and vocabulary: every word of the corpus has an id of its own (itself), and one
more stands for words that the corpus does not hold. Unigrams are smoothed by adding one; a bigram is mixed with its unigram
by Witten-Bell weights, ``(n(h, w) + t(h) * p(w)) / (n(h) + t(h))`` with ``t(h)`` the number of different words seen after
``h``, which for the first word is the beginning of a text. A document's score is the mean over its words of the loss under
the background model less the loss under the target model: the higher, the more it is like the target.

Counts cover all bigrams of all documents. They are Spark tables, which grow with the corpus: blocks of documents count their
distinct bigrams before these are shuffled, and facts of single words are joined to bigrams with hot words set apart. For
scores each block asks once for each of its distinct bigrams, as in ``word_bpe``; no text is shuffled for that.

``score_own`` scores the documents that the models are made of, in one go. Words are numbered once, over the whole corpus; a
block sends its distinct bigrams as packed numbers to the groups that total them, and gets the totals back in the same order.
So each bigram of a block crosses the shuffle once each way, in a few bytes, and each text is split once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.llm.texts import as_bytes, content_words, mix64
from silverprint.llm.word_bpe import blocks, offsets_of, pack_numbers, pack_stretches, unpack_numbers, unpack_stretches
from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise

#: Different words that a task holds before it hands their counts on.
HELD = 400_000
#: No words: the beginning of a text, and any word outside a vocabulary that was limited.
START, OTHER = b"", b" "
#: Bigrams that a group totals, on average; a word with more than a quarter of them behind it is spread over several groups.
GROUP = 1 << 20
#: Numbers before and behind those of all words: the beginning of a text, and any word (what follows it are single words).
FIRST, ANY = 0, (1 << 31) - 1


@dataclass
class Losses:
    """Tables of both models; counts ``target`` and ``background`` are of bigrams, of words after a word, and of words.

    ``ids`` is the limited vocabulary, or None where every word of the corpus counts; ``size`` is the number of ids.
    """

    ids: frozenset[bytes] | None
    bigrams: DataFrame
    contexts: DataFrame
    words: DataFrame
    size: int
    target: int
    background: int


def _splitter(ids: frozenset[bytes] | None) -> Callable[[bytes], list[bytes]]:
    return content_words if ids is None else lambda text: [w if w in ids else OTHER for w in content_words(text)]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for raw in as_bytes(batch.column("text")):
                held.update(content_words(raw))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(block) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """First and second words of a block's distinct bigrams; numbers of all bigrams; how many each text has.

    Bigrams are numbered in the order of their words, so that neighbours share bytes and the shuffle compresses them.
    """
    words = sorted(block.numbers)
    place = np.empty(len(words), np.int64)
    place[np.fromiter(map(block.numbers.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    words.append(START)
    lengths = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
    codes = place[np.concatenate([np.empty(0, np.int32), *block.texts])]
    before = np.roll(codes, 1)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(words) - 1
    distinct, numbers = np.unique(before * len(words) + codes, return_inverse=True)
    known = pa.array(words, pa.binary())
    first, second = (known.take(pa.array(x)) for x in np.divmod(distinct, len(words)))
    return first, second, numbers, lengths


def _in_parts(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names)


def _counted(docs: DataFrame, ids: frozenset[bytes] | None, text: str, target: str) -> DataFrame:
    """``(h, w, target, background)``: how often ``w`` follows ``h`` in the target documents and in all."""
    split = _splitter(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", ["target"], split):
            first, second, numbers, lengths = _bigrams(block)
            wanted = np.array([x for rows in block.rows for x in rows.column("target").to_pylist()], bool)
            everything = np.bincount(numbers, minlength=len(first))
            chosen = np.bincount(numbers[np.repeat(wanted, lengths)], minlength=len(first))
            yield from _in_parts([first, second, pa.array(chosen), pa.array(everything)], ["h", "w", "target", "background"])

    source = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(target), F.lit(False)).alias("target"))
    parts = source.mapInArrow(count, "h binary, w binary, target long, background long")
    return parts.groupBy("h", "w").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def fit(docs: DataFrame, target: str, text: str = "text", vocabulary: int | None = None, corpus: DataFrame | None = None) -> Losses:
    """Both models from ``docs``: the target one from rows whose column ``target`` is true, the background one from all.

    ``vocabulary`` limits the words with an id of their own to the most frequent ones; all others then share one. ``corpus``
    holds the same texts for that; where ``docs`` comes out of a join, the table itself spares a second one.
    """
    ids = None
    if vocabulary is not None:
        frequent = word_counts(docs if corpus is None else corpus, text).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
        ids = frozenset(bytes(r.word) for r in frequent)
    bigrams = materialise(_counted(docs, ids, text, target), "bigrams")
    sums = [F.sum("target").alias("target"), F.sum("background").alias("background"), F.count(F.lit(1)).alias("kinds")]
    contexts = materialise(bigrams.groupBy("h").agg(*sums, F.count_if(F.col("target") > 0).alias("target_kinds")), "contexts")
    words = materialise(bigrams.groupBy("w").agg(*sums), "words")
    total = words.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("target", "background")]).first()
    return Losses(ids, bigrams, contexts, words, (total.n if ids is None else len(ids)) + 1, total.target, total.background)


def _priced(pairs: DataFrame, model: Losses) -> DataFrame:
    """``(h, w, target_loss, background_loss)`` of distinct bigrams with their counts, null where there are none."""
    after = model.contexts.select("h", F.col("target").alias("target_after"), F.col("background").alias("background_after"), "target_kinds", F.col("kinds").alias("background_kinds"))
    own = model.words.select("w", F.col("target").alias("target_own"), F.col("background").alias("background_own"), F.col("kinds").alias("own_kinds"))
    facts = attach_facts(pairs, after, ["h"], F.col("background_kinds"), "w", keep_unmatched=True)
    facts = attach_facts(facts, own, ["w"], F.col("own_kinds"), "h", keep_unmatched=True)

    def loss(of: str, total: int) -> Column:
        n = lambda c: F.coalesce(F.col(f"{of}{c}"), F.lit(0)).cast("double")
        kinds = F.greatest(n("_kinds"), F.lit(1.0))
        return (-F.log((n("") + kinds * (n("_own") + 1) / F.lit(float(total + model.size))) / (n("_after") + kinds))).cast("float").alias(f"{of}_loss")

    return facts.select("h", "w", loss("target", model.target), loss("background", model.background))


def score(docs: DataFrame, model: Losses, text: str = "text", stored: bool = False, seen: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, mean ``target_loss`` and ``background_loss``, and ``score``, their difference.

    A text without words, null included, costs nothing and scores 0. Repeated rows score alike, columns of those names are
    replaced. ``stored=True`` says that ``docs`` is a plain read of a stored table, which need not be written first,
    ``seen=True`` that the model was made of the same texts; ``keep_text=False`` leaves the text out.
    """
    added = ["n_tokens", "target_loss", "background_loss", "score"]
    docs = docs.drop(*added)
    if not stored:
        docs = materialise(docs, "docs")
    kept = [c for c in docs.columns if keep_text or c != text]
    split = _splitter(model.ids)
    source = docs.select(*kept, F.col(text).cast("string").alias("_text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", [], split):
            first, second, _, _ = _bigrams(block)
            n = len(first)
            yield from _in_parts([pa.array(np.full(n, block.key)), pa.array(np.arange(n, dtype=np.int32)), first, second], ["block", "number", "h", "w"])

    held = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_numbers", T.BinaryType()), *docs.select(kept).schema.fields])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", kept, split):
            _, _, numbers, lengths = _bigrams(block)
            texts = iter(np.split(numbers, np.cumsum(lengths)))
            for rows in block.rows:
                packed = [pack_numbers(next(texts)) for _ in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), block.key)), pa.array(packed, pa.binary()), *rows.columns], held.names)

    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in added[1:]]])

    def judge(key: tuple, rows: pa.Table, prices: pa.Table) -> pa.Table:
        losses = np.zeros((2, prices.num_rows))
        losses[:, prices.column("number").to_numpy()] = [prices.column(c).to_numpy() for c in ("target_loss", "background_loss")]
        made = []
        for packed in rows.column("_numbers").to_pylist():
            numbers = unpack_numbers(packed)
            wanted, everything = losses[:, numbers].sum(1) / max(len(numbers), 1)
            made.append((len(numbers), wanted, everything, everything - wanted))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*made), (pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *columns], names=schema.names)

    asked = source.select("_text").mapInArrow(ask, "block long, number int, h binary, w binary")
    pairs = model.bigrams if seen else asked.select("h", "w").distinct().join(model.bigrams, ["h", "w"], "left")
    # a merge join at every size: the bigrams grow with the documents
    prices = asked.join(_priced(pairs, model).hint("merge"), ["h", "w"]).select("block", "number", "target_loss", "background_loss")
    return source.mapInArrow(hold, held).groupBy("_block").cogroup(prices.groupBy("block")).applyInArrow(judge, schema)


def _packed(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Stretches of numbers below 2^63, seven bits a byte, low ones first."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for i in range(1, 9):
        width += values >= np.uint64(1 << 7 * i)
    places = offsets_of(width)
    out = np.empty(places[-1], np.uint8)
    for i in range(int(width.max(initial=0))):
        has = width > i
        more = (width[has] > i + 1).astype(np.uint8) << 7
        out[places[:-1][has] + i] = (values[has] >> np.uint64(7 * i)).astype(np.uint8) & 127 | more
    packed, cuts = out.tobytes(), places[offsets].tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all stretches, and the offsets of the stretches."""
    raw = np.frombuffer(b"".join(packed), np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[-1], ends])[:-1] + 1
    out = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + i <= ends
        out[has] |= (raw[starts[has] + i].astype(np.int64) & 127) << (7 * i)
    return out, offsets_of(last)[offsets_of([len(p) for p in packed])]


def _sums_within(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running sums that start anew wherever ``begins`` is true, as it is at the first value."""
    sums = np.cumsum(values)
    at = np.flatnonzero(begins)
    return sums - np.repeat(sums[at] - values[at], np.diff(np.append(at, len(values))))


class _Asked:
    """What a block asks for: its distinct bigrams and, as bigrams behind ``ANY``, its words, in the order of the groups that
    total them. ``first`` and ``second`` are places in ``ids``, the sorted numbers of the block's words between the two others.

    One of these is in memory for each core, so arrays as long as the block are narrow and go as soon as they can."""

    def __init__(self, packed: pa.ChunkedArray, ids: np.ndarray, uses: np.ndarray, groups: int, hot: int):
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(1, len(ids) + 1)
        self.ids = np.concatenate([[FIRST], ids[order], [ANY]])
        n = len(self.ids)
        numbers, offsets = unpack_stretches(packed.to_pylist())
        self.lengths = np.diff(offsets)
        self.codes = place[numbers]
        del numbers
        keys = np.roll(self.codes, 1).astype(np.int64)
        keys[offsets[:-1][self.lengths > 0]] = 0
        keys *= n
        keys += self.codes
        by_key = np.argsort(keys)
        keys = keys[by_key]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        self.numbers = np.empty(len(keys), np.int32)
        self.numbers[by_key] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del by_key
        bigrams = keys[new]
        del keys, new
        self.n_bigrams = len(bigrams)
        bigrams = np.concatenate([bigrams, (n - 1) * n + np.arange(1, n - 1)])
        self.first = (bigrams // n).astype(np.int32)
        self.second = (bigrams % n).astype(np.int32)
        del bigrams
        # a word's bigrams are totalled in one group; those of a frequent one, and of the two that are no words, in several
        spread = np.concatenate([[groups], -(-uses[order] // hot), [groups]]).astype(np.uint64)
        group = mix64(self.ids.astype(np.uint64))[self.second]
        group %= spread[self.first]
        group |= (self.ids.astype(np.uint64) << np.uint64(32))[self.first]
        group = (mix64(group) % np.uint64(groups)).astype(np.int32)
        self.order = np.argsort(group, kind="stable").astype(np.int32)
        counts = np.bincount(group)
        self.groups = np.flatnonzero(counts)
        self.offsets = offsets_of(counts[self.groups])

    def per_bigram(self, weight: np.ndarray | None = None) -> np.ndarray:
        """How often each bigram and word stands in the texts, or in those whose ``weight`` is 1; in the order of the groups."""
        of_word = None if weight is None else np.repeat(weight, self.lengths)
        counts = np.bincount(self.numbers, of_word, self.n_bigrams), np.bincount(self.codes, of_word, len(self.ids))[1:-1]
        return np.concatenate(counts).astype(np.int64)[self.order]


def score_own(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``score(docs, fit(docs, ...))`` where the target documents are those whose ``key`` is in the table ``chosen``: the columns of
    ``docs`` but the text, and those that ``score`` adds.

    Each text is read and split once. What is stored and moved are packed word numbers of the documents, the distinct words of
    blocks, and distinct bigrams of blocks as packed differences. ``group`` bounds how many bigrams one task totals at a time;
    the scores are the same for any.
    """
    added = ["n_tokens", "target_loss", "background_loss", "score"]
    docs = docs.drop(*added)
    kept = [c for c in docs.columns if c != text]
    fields = [T.StructField(f.name, f.dataType) for f in docs.select(kept).schema.fields]
    words_of = ["_block", "_at", "_word", "_uses"]
    kinds = zip([*words_of, "_numbers"], (T.LongType(), T.IntegerType(), T.BinaryType(), T.LongType(), T.BinaryType()))
    stored = T.StructType([*[T.StructField(c, t) for c, t in kinds], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", kept, content_words):
            known = pa.array(list(block.numbers), pa.binary())
            uses = np.bincount(np.concatenate([np.empty(0, np.int32), *block.texts]), minlength=len(known))
            for at in range(0, len(known), 50_000):
                part = known.slice(at, 50_000)
                numbers = pa.array(np.arange(at, at + len(part), dtype=np.int32))
                nothing = [pa.nulls(len(part), pa.binary()), *(pa.nulls(len(part), block.rows[0].column(c).type) for c in kept)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.key)), numbers, part, pa.array(uses[at : at + len(part)]), *nothing], stored.names)
            at = 0
            for rows in block.rows:
                n, texts = rows.num_rows, block.texts[at : at + rows.num_rows]
                packed = pack_stretches(np.concatenate(texts), offsets_of([len(t) for t in texts]))
                places = pa.array(np.arange(at, at + n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.key)), places, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(packed, pa.binary()), *rows.columns], stored.names)
                at += n

    made = materialise(docs.select(*kept, F.col(text).cast("string").alias("_text")).mapInArrow(cut, stored), "blocks")
    held = made.filter(F.col("_numbers").isNotNull()).select("_block", "_at", "_numbers", *kept)

    # a word's number is its rank by use among the words of its partition, so that frequent words have small numbers
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = made.filter(F.col("_word").isNotNull()).select(*words_of).repartition(parts, "_word").groupBy("_word")
    known = known.agg(F.sum("_uses").alias("uses"), F.collect_list(F.struct("_block", "_at")).alias("asked")).sortWithinPartitions(F.desc("uses"))
    ranked = known.select(F.monotonically_increasing_id().alias("row"), "uses", "asked")
    number = F.col("row").bitwiseAND((1 << 33) - 1) * parts + F.shiftrightunsigned("row", 33) + 1
    words = materialise(ranked.select(number.alias("id"), "uses", "asked"), "words")
    found = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()
    if found.last >= ANY:
        raise ValueError("more words than numbers")
    size, groups, hot = found.n + 1, -(-found.uses // group) or 1, max(group // 4, 1)
    asked = lambda table, *more: table.select(F.explode("asked").alias("a"), "id", "uses", *more).select("a._block", "a._at", "id", "uses", *more)
    wanted = held.select(key, "_block", "_at").join(chosen.select(key).distinct().hint("merge"), key).select("_block", "_at")

    def by_number(facts: pa.Table) -> tuple[np.ndarray, pa.Table]:
        facts = facts.sort_by("_at")
        return facts.column("id").to_numpy(), facts

    def ask(key: tuple, rows: pa.Table, facts: pa.Table) -> pa.Table:
        is_word = facts.column("id").is_valid()
        ids, known = by_number(facts.filter(is_word))
        target = np.isin(rows.column("_at").to_numpy(), facts.filter(pc.invert(is_word)).column("_at").to_numpy())
        block = _Asked(rows.column("_numbers"), ids, known.column("uses").to_numpy(), groups, hot)
        # of each bigram the step from the one before in its group, in the first word and, where that is the same, in the second
        step = np.diff(block.ids[block.first[block.order]], prepend=0)
        step[block.offsets[:-1]] = block.ids[block.first[block.order[block.offsets[:-1]]]]
        new = step != 0
        new[block.offsets[:-1]] = True
        packed = [pa.array(_packed(step, block.offsets), pa.binary())]
        second = block.ids[block.second[block.order]]
        step = np.diff(second, prepend=0)
        step[new] = second[new]
        del second, new
        packed.append(pa.array(_packed(step, block.offsets), pa.binary()))
        del step
        packed.extend(pa.array(_packed(block.per_bigram(x), block.offsets), pa.binary()) for x in (target.astype(float), None))
        return pa.Table.from_arrays([pa.array(np.full(len(block.groups), rows.column("_block")[0].as_py())), pa.array(block.groups), *packed], names=["_block", "group", "h", "w", "target", "background"])

    context = ["target_after", "background_after", "target_kinds", "background_kinds"]
    totalled = T.StructType([
        T.StructField("_block", T.LongType()), T.StructField("group", T.LongType()), T.StructField("target", T.BinaryType()), T.StructField("background", T.BinaryType()),
        *[T.StructField(c, T.LongType()) for c in ("id", *context)],
    ])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        h, offsets = _unpacked(rows.column("h").to_pylist())
        new = np.zeros(len(h) + 1, bool)
        new[offsets] = True
        new_h = new[:-1] | (h != 0)
        h = _sums_within(h, new[:-1])
        w = _sums_within(_unpacked(rows.column("w").to_pylist())[0], new_h)
        bigrams, numbers = np.unique(h << 32 | w, return_inverse=True)
        # sums of whole numbers below 2^53 are exact
        sums = [np.bincount(numbers, _unpacked(rows.column(c).to_pylist())[0]).astype(np.int64) for c in ("target", "background")]
        packed = [pa.array(_packed(x[numbers], offsets), pa.binary()) for x in sums]
        back = [rows.column("_block"), rows.column("group"), *packed, *[pa.nulls(rows.num_rows, pa.int64())] * 5]
        firsts, at = np.unique(bigrams >> 32, return_index=True)
        facts = [np.add.reduceat(x, at) for x in (*sums, sums[0] > 0, np.ones(len(bigrams), np.int64))]
        real = firsts != ANY
        n = int(real.sum())
        after = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *(pa.array(x[real].astype(np.int64)) for x in (firsts, *facts))]
        return pa.concat_tables([pa.Table.from_arrays(x, names=totalled.names) for x in (back, after)])

    first_facts = asked(words).unionByName(wanted, allowMissingColumns=True)
    messages = held.select("_block", "_at", "_numbers").groupBy("_block").cogroup(first_facts.groupBy("_block"))
    messages = messages.applyInArrow(ask, "_block long, group long, h binary, w binary, target binary, background binary")
    totals = materialise(messages.groupBy("group").applyInArrow(total, totalled), "totals")
    contexts = totals.filter(F.col("id").isNotNull()).groupBy("id").agg(*[F.sum(c).alias(c) for c in context])
    at_first = [F.coalesce(F.sum(F.when(F.col("id") == FIRST, F.col(c))), F.lit(0)) for c in context]
    whole = totals.agg(F.coalesce(F.sum("target_after"), F.lit(0)).alias("target"), F.array(*at_first).alias("first")).first()
    of_all, of_first = (whole.target, found.uses), np.array(whole.first, np.int64).reshape(4, 1)

    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in added[1:]]])

    def judge(key: tuple, rows: pa.Table, facts: pa.Table) -> pa.Table:
        is_word = facts.column("id").is_valid()
        ids, known = by_number(facts.filter(is_word))
        block = _Asked(rows.column("_numbers"), ids, known.column("uses").to_numpy(), groups, hot)
        after = np.array([pc.fill_null(known.column(c), 0).to_numpy() for c in context]).reshape(4, -1)
        after = np.concatenate([of_first, after[:, np.argsort(ids)]], 1)
        answers = facts.filter(pc.invert(is_word)).sort_by("group")
        made = []
        for i, of in enumerate(("target", "background")):
            n = np.empty(len(block.order))
            n[block.order] = _unpacked(answers.column(of).to_pylist())[0]
            n, own = n[: block.n_bigrams], n[block.n_bigrams :]
            h, w = block.first[: block.n_bigrams], block.second[: block.n_bigrams]
            several = np.maximum(after[2 + i], 1.0)
            loss = -np.log((n + several[h] * (own[w - 1] + 1) / float(of_all[i] + size)) / (after[i] + several)[h])
            del n
            texts = np.split(block.numbers, np.cumsum(block.lengths)[:-1]) if rows.num_rows else []
            made.append(np.array([loss[t].sum() for t in texts]) / np.maximum(block.lengths, 1))
        columns = [pa.array(x) for x in (block.lengths, *made, made[1] - made[0])]
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *columns], names=schema.names)

    last_facts = asked(words.join(contexts.hint("merge"), "id", "left"), *context)
    last_facts = last_facts.unionByName(totals.filter(F.col("group").isNotNull()).select("_block", "group", "target", "background"), allowMissingColumns=True)
    return held.groupBy("_block").cogroup(last_facts.groupBy("_block")).applyInArrow(judge, schema)
