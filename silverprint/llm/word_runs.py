"""Runs of repeating words: stretches with a short period, found in one pass over the words of a document.

At each word its earlier occurrences count up the match lengths of their lags (the diagonals of the word-by-word match
matrix); a lag that stops matching is emitted at once if its stretch is long enough. Two exact savings keep the matrix sparse:

* A stretch of ``power`` periods and ``least`` words matches itself at its lag over a known least number of words in a row (five
  for the defaults). A lag is therefore only taken up at words whose last five words occurred before; prose has hardly any.
* While a stretch of period ``q`` that is long enough goes on, no lag from ``q`` on is taken up. A long stretch of a larger
  period that shares ``d + q`` words with it would have a multiple of ``q`` as its lag and not its smallest period; any other
  must go on behind its end, where it is found with its whole length by looking back.

So one word repeated through a whole text costs one lag and not all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from silverprint.llm.texts import as_bytes, map_rows

#: Least words of a run, and least periods it holds.
LEAST_WORDS = 6
LEAST_PERIODS = 4

Run = tuple[int, int, int]  # first word, words, period


def find_runs(words: list, least: int = LEAST_WORDS, power: int = LEAST_PERIODS) -> list[Run]:
    """Maximal stretches with smallest period ``q`` and at least ``max(least, power * q)`` words, by start and period."""
    n = len(words)
    if n < least:
        return []
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    context = min(max(least, power * d) - d for d in range(1, least + 1))
    grams = list(zip(*(ids[k:] for k in range(context))))
    if len(set(grams)) == len(grams):
        return []

    earlier = [-1] * n  # where the same context ended last
    seen: dict = {}
    for end, gram in enumerate(grams, context - 1):
        earlier[end] = seen.get(gram, -1)
        seen[gram] = end

    active: dict[int, int] = {}  # lag: first word of its stretch
    long_enough: set[int] = set()
    runs: list[Run] = []
    for i in range(context - 1, n + 1):
        ripe = []
        for lag, start in list(active.items()):
            if i < n and ids[i] == ids[i - lag]:
                if lag not in long_enough and i + 1 - start >= max(least, power * lag):
                    ripe.append(lag)
                continue
            del active[lag]
            if lag in long_enough:
                long_enough.remove(lag)
                runs.append((start, i - start, lag))
        if i == n:
            break
        below = min(n // power, min(long_enough) - 1 if long_enough else n)
        j = earlier[i]
        while j >= 0 and i - j <= below:
            lag = i - j
            if lag not in active:
                k = i - context
                while k >= lag and ids[k] == ids[k - lag]:
                    k -= 1
                active[lag] = k + 1 - lag
                if i + 1 - active[lag] >= max(least, power * lag):
                    ripe.append(lag)
            j = earlier[j]
        for lag in sorted(ripe):
            if lag in active:
                long_enough.add(lag)
                for other in [o for o, start in active.items() if o > lag and o % lag == 0 and start == active[lag]]:
                    del active[other]
                    long_enough.discard(other)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept, upto = [], 0
    for first, end in sorted((start + period, start + length) for start, length, period in runs):
        if first > upto:
            kept += words[upto:first]
        upto = max(upto, end)
    return kept + words[upto:]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, power: int = LEAST_PERIODS) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (first word, words, period; by start, then period) and ``collapsed``, the text without repeats.

    Words are runs of anything but ASCII white space, as they stand. A null text has no words; texts without words collapse to
    the empty text; ids may be null or repeat, every row is worked on by itself. Other columns are left out. A document is
    read whole: a task holds the words of about a megabyte of texts, or of one longer text.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found, texts = [], [], []
        for text in as_bytes(batch.column(1)):
            words = text.split() if text else []
            runs = find_runs(words, least, power)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            texts.append(b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass"))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run)), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    two = docs.select(id_col, text_col)
    kind = two.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(two, work, schema, text_col)
