"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of consecutive words of every item. Documents are streamed through it word
by word; the state holds the longest suffix read so far that is such a run. A run of at least ``window`` words
therefore marks all its words as taken from the benchmark, and an item shorter than that counts when it
occurs whole. Document words that no item has send the automaton back to its root, so only stretches of known
words are streamed.

The items are cut into blocks of at most ``BLOCK_WORDS`` words, each block is one broadcast automaton of
bounded size, and every document passes all of them in turn: nothing is shuffled and no benchmark is too large.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.llm.texts import as_bytes, content_spans, content_words, map_rows
from silverprint.workspace import materialise

WINDOW = 10
#: Words of one automaton, and of one piece of a long item.
BLOCK_WORDS = 100_000
PIECE_WORDS = 2_000
SPANS = "array<struct<first:int,last:int>>"


class ItemAutomaton:
    """Suffix automaton of several word sequences; ``pieces`` holds (item id, words, whether it is a whole short item)."""

    def __init__(self, pieces: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, steps = [0], [-1], [{}]
        owned: list[tuple[str, list[int]]] = []
        for item, words in pieces:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            owned.append((item, tokens))
            last = 0
            for token in tokens:
                last = self._extend(steps, last, token)
        self.size = max(1, len(self.vocabulary))
        self.step = {state * self.size + token: to for state, row in enumerate(steps) for token, to in row.items()}
        self._own(owned)
        self.shortest = min([len(tokens) for _, tokens in owned if tokens] + [window])

    def _extend(self, steps: list[dict[int, int]], last: int, token: int) -> int:
        """Append ``token`` after state ``last``; states of earlier items are reused or split."""
        known = steps[last].get(token)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        fresh = None
        if known is None:
            fresh = self._state(steps, self.length[last] + 1, 0, {})
            at = last
            while at >= 0 and token not in steps[at]:
                steps[at][token] = fresh
                at = self.link[at]
            if at < 0:
                return fresh
            last, known = at, steps[at][token]
            if self.length[known] == self.length[at] + 1:
                self.link[fresh] = known
                return fresh
        split = self._state(steps, self.length[last] + 1, self.link[known], dict(steps[known]))
        at = last
        while at >= 0 and steps[at].get(token) == known:
            steps[at][token] = split
            at = self.link[at]
        self.link[known] = split
        if fresh is None:
            return split
        self.link[fresh] = split
        return fresh

    def _state(self, steps: list[dict[int, int]], length: int, link: int, row: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        steps.append(row)
        return len(steps) - 1

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words read when at least as many are matched."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _own(self, owned: list[tuple[str, list[int]]]) -> None:
        """Which items hold the run of a window state, and which short items end whole in a state."""
        self.holders: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for item, tokens in owned:
            state = 0
            for i, token in enumerate(tokens):
                state = self.step[state * self.size + token]
                if i + 1 >= self.window:
                    self.holders.setdefault(self._window_state(state), set()).add(item)
            if 0 < len(tokens) < self.window:
                self.short.setdefault(state, set()).add(item)
        #: nearest state on the way to the root, the state itself included, that ends a short item
        self.next_short = {}
        if self.short:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                above = self.next_short.get(self.link[state]) if state else None
                found = state if state in self.short else above
                if found is not None:
                    self.next_short[state] = found

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (first and last word) that are taken from items, and those items."""
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known >= 0, [False]]).view(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start >= self.shortest:
                self._stream(known[start:end].tolist(), start, spans, items)
        return merged(spans), items

    def _stream(self, tokens: list[int], offset: int, spans: list, items: set) -> None:
        step, link, longest, size, window = self.step, self.link, self.length, self.size, self.window
        seen: set[int] = set()
        state = length = 0
        for i, token in enumerate(tokens, offset):
            to = step.get(state * size + token)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = step.get(state * size + token)
            if to is None:
                length = 0
                continue
            state = to
            length += 1
            if length >= window:
                spans.append((i - length + 1, i))
                seen.add(self._window_state(state))
            at = self.next_short.get(state) if self.next_short else None
            if at == state and longest[state] != length:
                at = self.next_short.get(link[state])
            while at is not None:
                spans.append((i - longest[at] + 1, i))
                items |= self.short[at]
                at = self.next_short.get(link[at])
        for at in seen:
            items |= self.holders[at]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _pieces(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """Item words in pieces of bounded length that overlap by a window less one, so that no window is lost."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {"item": [], "words": [], "n": []}
        for item, raw in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text"))):
            words = content_words(raw)
            for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ():
                piece = words[at : at + PIECE_WORDS + window - 1]
                rows["item"].append(item)
                rows["words"].append(b" ".join(piece))
                rows["n"].append(len(piece))
        return pa.RecordBatch.from_pydict(rows, pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())]))

    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
    return map_rows(source, cut, "item string, words binary, n long").distinct()


def automata(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> list[ItemAutomaton]:
    """The automata of all items, each over at most ``BLOCK_WORDS`` words."""
    pieces = _pieces(items, window, item_id, text)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_WORDS)) if total > BLOCK_WORDS else 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    while (pieces.groupBy(block.alias("block")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > BLOCK_WORDS:
        blocks *= 2
        block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    made = []
    for number in range(blocks):
        rows = pieces.filter(block == number).select("item", "words").collect()  # at most BLOCK_WORDS words
        made.append(ItemAutomaton(sorted((r.item, bytes(r.words).split()) for r in rows), window))
    return made


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (taken runs of words, from 0) and ``items`` (ids as strings, sorted).

    A null or empty text has no words and no spans; an item without words is never found; items of one id count
    once, those without id under ``"null"``; repeated documents each get their row. Columns of ``docs`` called
    ``n_words``, ``spans`` or ``items`` are replaced. ``keep_text=False`` leaves the text out.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    found = docs.select(*kept, F.lit(0).alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for automaton in automata(items, window, item_id):
        found = _through(found, automaton, text)
    return found if keep_text else found.drop(text)


def _through(docs: DataFrame, automaton: ItemAutomaton, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = shared.value
        counts, spans, items = [], [], []
        before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        for raw, (old_spans, old_items) in zip(as_bytes(batch.column(text)), before):
            words = content_words(raw)
            new_spans, new_items = matcher.match(words)
            if old_spans:
                new_spans = merged([*new_spans, *((s["first"], s["last"]) for s in old_spans)])
            counts.append(len(words))
            spans.append([{"first": a, "last": b} for a, b in new_spans])
            items.append(sorted(new_items.union(old_items)))
        made = {"n_words": counts, "spans": spans, "items": items}
        columns = [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in batch.schema]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, scan, docs.schema, text)


def cut_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without benchmark text: documents covered by more than ``max_coverage`` go, other spans are cut out.

    Coverage is judged once, on the words as they came. A cut is repeated until no window of any item is left, since the
    words on both sides of it come together. Untouched texts come back byte by byte. Null and empty texts stay. The result
    does not depend on the blocks that the items are dealt to: with several, spans of all are gathered before a cut, and texts
    that were cut pass all of them again.
    """
    made = automata(items, window, item_id)
    if len(made) == 1:
        covered = "_covered"
        cut = _without(docs.withColumn(covered, F.lit(0.0)), made[0], text, covered)
        return cut.filter(F.col(covered) <= max_coverage).drop(covered)
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col(text).cast("string").alias("_text"), F.lit(0).alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    left, done = F.try_divide(n_hit, F.col("n_words")) <= max_coverage, None
    while True:
        for automaton in made:
            rows = _through(rows, automaton, "_text")
        found = materialise(rows, "overlaps")
        clean = found.filter(F.size("spans") == 0).select("_doc", "_text")
        done = clean if done is None else done.union(clean)
        hit = found.filter(F.size("spans") > 0).filter(left)
        if hit.isEmpty():
            break
        rows, left = map_rows(hit, _cut_batch, hit.schema, "_text"), F.lit(True)
    return done.select(*[F.col("_text").cast(f.dataType).alias(text) if f.name == text else F.col("_doc")[f.name].alias(f.name) for f in docs.schema.fields])


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without its ``spans`` of words; what stood around them is joined by a line break."""
    at = content_spans(raw)
    ends = [0, *(x for a, b in spans for x in (at[a][0], at[b][1])), len(raw)]
    return b"\n".join(p for p in (raw[s:e].strip() for s, e in zip(ends[::2], ends[1::2])) if p)


def _cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts without their spans, which are empty afterwards."""
    spans = [[(s["first"], s["last"]) for s in row] for row in batch.column("spans").to_pylist()]
    texts = [_cut(raw, row) for raw, row in zip(as_bytes(batch.column("_text")), spans)]
    none = [[] for _ in texts]
    made = {"_text": pa.array(texts, pa.binary()).cast(pa.string()), "spans": none, "items": none}
    columns = [pa.array(made[f.name], f.type) if f.name in ("spans", "items") else made[f.name].cast(f.type) if f.name in made else batch.column(f.name) for f in batch.schema]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _without(docs: DataFrame, automaton: ItemAutomaton, text: str, covered: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def trim(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = shared.value
        texts, shares = as_bytes(batch.column(text)), batch.column(covered).to_pylist()
        changed = False
        for k, raw in enumerate(texts):
            words = content_words(raw)
            spans, _ = matcher.match(words)
            if spans:
                changed = True
                shares[k] += sum(b - a + 1 for a, b in spans) / len(words)
            while spans:
                raw = _cut(raw, spans)
                spans, _ = matcher.match(content_words(raw))
            texts[k] = raw
        if not changed:
            return batch
        made = {text: pa.array(texts, pa.binary()).cast(pa.string()), covered: pa.array(shares, pa.float64())}
        columns = [made[f.name].cast(f.type) if f.name in made else batch.column(f.name) for f in batch.schema]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, trim, T.StructType(docs.schema.fields), text)
