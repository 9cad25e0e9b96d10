"""Wrappers for the caller's own models.

Each takes a loader; the model is loaded once per Python worker and then sees Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

FACES = "array<struct<x:int,y:int,w:int,h:int,descriptor:array<float>>>"
OCR = "text string, language string, char_count int"


def _batched(load: Callable[[], Callable], returns: str, wrap: Callable):
    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield wrap(batch, model)

    return apply


def encode(load: Callable[[], Callable[[object], list[float]]]):
    """Image bytes or text to a unit vector."""

    def one(value, model):
        if value is None:
            return None
        vector = [float(x) for x in model(value)]
        length = sum(x * x for x in vector) ** 0.5 or 1.0
        return [x / length for x in vector]

    return _batched(load, "array<float>", lambda batch, model: pd.Series([one(v, model) for v in batch], dtype=object))


def detect_faces(load: Callable[[], Callable[[bytes], list[dict]]]):
    """Image bytes to faces; an image without faces gives an empty array, no image gives null."""
    return _batched(
        load, FACES, lambda batch, model: pd.Series([None if v is None else model(v) for v in batch], dtype=object)
    )


def ocr(load: Callable[[], Callable[[bytes], tuple[str, str]]]):
    """Image bytes to text and language."""

    @F.pandas_udf(OCR)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            read = [("", "") if v is None else model(v) for v in batch]
            yield pd.DataFrame(
                {"text": [t for t, _ in read], "language": [l for _, l in read], "char_count": [len(t) for t, _ in read]}
            ).astype({"char_count": "int32"})

    return apply
