"""Vector expressions. Elements are widened to double before they are multiplied."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _paired(a: Column, b: Column, combine) -> Column:
    shared = F.least(F.size(a), F.size(b))
    return F.zip_with(
        F.slice(a, F.lit(1), shared),
        F.slice(b, F.lit(1), shared),
        lambda x, y: combine(x.cast("double"), y.cast("double")),
    )


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector is returned as it is."""
    length = norm(v)
    divisor = F.when(length == 0, F.lit(1.0)).otherwise(length)
    # the divisor is an element of an array: written into the inner lambda it would be computed for every element
    return F.transform(F.array(divisor), lambda d: F.transform(v, lambda x: x.cast("double") / d))[0]


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length: the cosine of two unit vectors."""
    return _total(_paired(a, b, lambda x, y: x * y))


def dot_with(v: Column, query: Sequence[float]) -> Column:
    """Dot product with a fixed query vector, a batch of rows at a time; over the shorter length, null for null."""
    fixed = np.array([float(x) for x in query])

    def products(vectors: pd.Series) -> pd.Series:
        lengths = vectors.map(len, na_action="ignore")
        if len(vectors) and (lengths == len(fixed)).all():
            return pd.Series(np.stack(vectors.to_numpy()).astype(np.float64) @ fixed)
        return vectors.map(lambda x: float(np.asarray(x[: len(fixed)], np.float64) @ fixed[: len(x)]), na_action="ignore").astype("Float64")

    return F.pandas_udf(products, "double")(v)


def unit_vector(v: Sequence[float]) -> list[float]:
    """A vector of the caller scaled to unit length; a zero vector stays."""
    values = np.asarray(v, np.float64)
    return (values / (np.sqrt((values * values).sum()) or 1.0)).tolist()


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(_paired(a, b, lambda x, y: (x - y) * (x - y))))
