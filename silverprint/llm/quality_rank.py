"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile cut.

A pair says that a document of label 1 is better than one of label 0. The model gives each document a margin
``w . x`` and the pair the probability ``sigmoid(w . (x_better - x_worse))``; Newton steps minimise the loss over
the pairs with an L2 penalty. The cut is the quantile of the training margins at the share of label 0, and margins
become scores so that a margin on the cut has score ``CUT_SCORE``.

The model is fitted on at most ``SAMPLE`` labelled documents (those with the smallest id hashes); every document is
scored, from its whole text and from nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.llm.texts import as_bytes, map_rows

#: Most labelled documents that the model is fitted on, and preference pairs among them.
SAMPLE = 20_000
PAIRS = 30_000
#: Score of a margin on the cut; documents from here on are kept.
CUT_SCORE = 0.3
FOLDS = 5
PENALTY = 1e-2
_SHAPE = 16


def fold(doc_id: Column) -> Column:
    """Fold 0 is held out: its labels are never learned from. A missing id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def features(raw: bytes | None) -> np.ndarray:
    """Byte frequencies (square roots) and shape of a text: repetition, word and line forms."""
    raw = raw or b""
    out = np.zeros(256 + _SHAPE, np.float32)
    if not raw:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    words = raw.split()
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    sentences = [x for x in raw.split(b".") if x]
    bare = sum(c for w, c in counts.items() if not w.strip(b"|#$%&*!.,;:-_=+~^/\\<>()[]{}?'\""))
    upper = sum(c for w, c in counts.items() if w.isupper())
    marked = sum(c for w, c in counts.items() if 32 < w[-1] < 48 or 57 < w[-1] < 65 or 90 < w[-1] < 97 or 122 < w[-1] < 127)
    out[256:] = [
        1,
        np.log1p(len(raw)),
        np.log1p(n),
        len(counts) / n,
        np.log(n / max(len(counts), 1)),
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        len(set(zip(words, words[1:], words[2:]))) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(sentences)) / max(len(sentences), 1),
        np.log1p(n / max(len(lines), 1)),
        len(raw) / n / 10,
        bare / n,
        upper / n,
        marked / n,
    ]
    return out


@dataclass
class Ranking:
    """Weights over standardised features, the cut and the slope that turn a margin into a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        margins = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE)), -60, 60)))


#: Rows that the fit holds as double at once.
_BLOCK = 2_000


def _newton(rows: Callable[[int, int], np.ndarray], y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Weights of a logistic loss with outcomes ``y``; ``rows(a, b)`` gives feature rows a to b, so only a block is made at a time."""
    w = None
    for _ in range(steps):
        gradient = hessian = 0.0
        for at in range(0, len(y), _BLOCK):
            x = np.asarray(rows(at, at + _BLOCK), np.float64)
            w = np.zeros(x.shape[1]) if w is None else w
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = gradient + x.T @ (p - y[at : at + _BLOCK])
            hessian = hessian + (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(hessian / len(y) + penalty * np.eye(len(w)), gradient / len(y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank(x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY) -> Ranking:
    """Fit on feature rows ``x`` and their labels; without both labels every document scores ``CUT_SCORE``."""
    mean, scale = (x.mean(0, np.float64), x.std(0, np.float64) + 1e-3) if len(x) else (np.zeros(256 + _SHAPE), np.ones(256 + _SHAPE))
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(len(mean)), 0.0, 1.0)
    rng = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    # every document of either label stands in a pair before any stands in a second one more often
    up = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    down = np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    weights = _newton(lambda a, b: (x[up[a:b]].astype(np.float64) - x[down[a:b]]) / scale, np.ones(n), penalty)
    margins = np.concatenate([(x[at : at + _BLOCK] - mean) / scale @ weights for at in range(0, len(x), _BLOCK)])
    cut = float(np.quantile(margins, len(bad) / len(x), method="midpoint"))
    lifted = np.stack([margins - cut, np.ones(len(x))], 1)
    slope = float(_newton(lambda a, b: lifted[a:b], better.astype(float), 1e-3)[0])
    return Ranking(mean, scale, weights, cut, max(slope, 1e-3))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ranking:
    """Learn from ``labels`` (id and 0 or 1) outside the held-out fold. Rows without id or label teach nothing."""
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter((fold(F.col("id")) != 0) & F.col("label").isin(0, 1))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t).tobytes() for t in as_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], ["id", "label", "x"])

    # at most ``sample`` rows of about a kilobyte
    rows = map_rows(texts, describe, "id long, label int, x binary").dropDuplicates(["id", "label"]).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    x = np.empty((len(rows), 256 + _SHAPE), np.float32)
    for i, raw in enumerate(rows.column("x")):
        x[i] = np.frombuffer(raw.as_buffer(), np.float32)
    return rank(x, rows.column("label").to_numpy() == 1)


def score(docs: DataFrame, ranking: Ranking, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each text in ``column``; null counts as empty, an old ``column`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)
    kept = docs.drop(column)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(np.stack([features(t) for t in as_bytes(batch.column(text))]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return map_rows(kept, judge, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]), text)


def keep_good(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """Documents at or above the cut, with their columns as they were."""
    return score(docs, ranking, text, "_score").filter(F.col("_score") >= CUT_SCORE).drop("_score")
