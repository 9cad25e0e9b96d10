"""Exact lowest and highest fractions without a sort and without a shuffle of the rows.

The last value that belongs to a fraction is found by aggregates alone: a percentile sketch names values around the wanted rank,
exact counts below and up to these values tell which of them is the one, or between which two it lies, and only the values in
between are looked at next. A sketch is off by at most one in ``accuracy`` of the rows it saw, so that three rounds do for
10^12 rows, and only a counted value is taken. Rows that share this last value are taken by id; the last id is found in the same
way, by counts of the next characters. The answer is then a filter. All rules share each pass.
"""

from __future__ import annotations

import math
import os.path
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.operators.ranking import QuantileRule

#: Ids that are counted by their next characters until at most this many are left.
FEW_IDS = 4_096
_NEXT_CHARACTERS = 2


@dataclass
class _Search:
    """How far the search for one rule's last value, and then for its last id, has come."""

    rule: QuantileRule
    key: Column
    n: int = 0
    take: int = 0
    low: float | None = None  # the value is above
    high: float | None = None  # the value is below
    below: int = 0  # rows up to ``low``
    inside: int = 0  # rows between the two
    probes: list[float] = field(default_factory=list)
    cut: float | None = None
    last_id: str | None = None  # None: all rows of the value belong to the fraction

    def within(self) -> Column:
        held = self.key.isNotNull()
        if self.low is not None:
            held = held & (self.key > self.low)
        return held if self.high is None else held & (self.key < self.high)


def _sortable(df: DataFrame, id_col: str) -> Column:
    """Ids as text in the same order; a missing id is the first."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(id_col), F.lit(""))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        shifted = F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
        return F.coalesce(F.lpad(F.hex(shifted), 16, "0"), F.lit(""))
    raise ValueError(f"{id_col} must be text or a whole number")


def _one_row(df: DataFrame, values: list[Column]):
    return df.agg(*[v.alias(f"_{i}") for i, v in enumerate(values)]).head()


def _probe(df: DataFrame, open_: list[_Search], accuracy: int) -> None:
    """Name values around the wanted rank of each search."""
    values = []
    for s in open_:
        share = (s.take - s.below) / s.inside if s.inside else s.rule.q
        near = sorted({min(1.0, max(0.0, share + move / accuracy)) for move in (-2, 0, 2)})
        values += [F.count(F.when(s.within(), s.key)), F.percentile_approx(F.when(s.within(), s.key), near, accuracy)]
    row = _one_row(df, values)
    for i, s in enumerate(open_):
        s.inside, s.probes = row[2 * i], sorted(set(row[2 * i + 1] or []))
        if s.low is None and s.high is None:
            s.n = s.inside
            s.take = min(s.n, max(3, math.ceil(s.n * s.rule.q)))


def _count(df: DataFrame, open_: list[_Search], ties: dict[int, tuple[int, int]]) -> None:
    """Count the rows below and up to each named value; take it, or go on below or above it."""
    asked = [(s, p) for s in open_ for p in s.probes]
    row = _one_row(df, [F.count(F.when(c, 1)) for s, p in asked for c in (s.key < p, s.key <= p)])
    ends = {id(s): s.below + s.inside for s in open_}
    for i, (s, p) in enumerate(asked):
        less, upto = row[2 * i], row[2 * i + 1]
        if less < s.take <= upto:
            s.cut = p
            ties[id(s)] = (s.take - less, upto - less)
        elif s.take > upto and (s.low is None or p > s.low):
            s.low, s.below = p, upto
        elif s.take <= less and (s.high is None or p < s.high):
            s.high, ends[id(s)] = p, less
    for s in open_:
        s.inside = ends[id(s)] - s.below


def _last_ids(df: DataFrame, searches: list[_Search], ties: dict[int, tuple[int, int]]) -> None:
    """The last id to take among the rows that share the last value, where not all of them belong."""
    left = {i: list(ties[id(s)]) for i, s in enumerate(searches) if id(s) in ties and ties[id(s)][0] < ties[id(s)][1]}
    if not left:
        return
    same = {i: searches[i].key == searches[i].cut for i in left}
    row = _one_row(df, [f(F.when(same[i], F.col("_id"))) for i in left for f in (F.min, F.max)])
    start = {i: os.path.commonprefix([row[2 * j], row[2 * j + 1]]) for j, i in enumerate(left)}
    while left:
        entries = []
        for i, (_, rows) in left.items():
            whole = rows <= FEW_IDS
            rest = F.expr(f"substring(_id, {len(start[i]) + 1}" + (")" if whole else f", {_NEXT_CHARACTERS})"))
            entries.append(F.when(same[i] & F.col("_id").startswith(start[i]), F.struct(F.lit(i).alias("i"), rest.alias("rest"))))
        flat = df.select(F.explode(F.array_compact(F.array(*entries))).alias("_e"))
        counted: dict[int, list[tuple[str, int]]] = {i: [] for i in left}
        # at most FEW_IDS rows, or one for each pair of characters that ids have here
        for r in flat.groupBy("_e.i", "_e.rest").count().collect():
            counted[r["i"]].append((r["rest"], r["count"]))
        for i, groups in counted.items():
            whole = left[i][1] <= FEW_IDS
            for rest, rows in sorted(groups):
                if rows >= left[i][0]:
                    start[i], left[i][1] = start[i] + rest, rows
                    break
                left[i][0] -= rows
            if whole or len(rest) < _NEXT_CHARACTERS:
                searches[i].last_id = start[i]
                del left[i]


def quantile_members(
    df: DataFrame, rules: list[QuantileRule], id_col: str = "media_id", carry: tuple[str, ...] = (), accuracy: int = 10_000
) -> DataFrame:
    """Members of each rule: the first min(n, max(3, ceil(n * q))) rows by value, ties by id: ``rule``, id, ``carry``, ``value``.

    The same rows as :func:`silverprint.operators.ranking.quantile_items`, without their positions. Missing and infinite values
    and NaN belong to no rule; rows with equal id and equal value are taken together. ``df`` is read some five times, a few
    columns each, so it should be a stored table or cheap to compute.
    """
    keys = {}
    for i, rule in enumerate(rules):
        v = F.col(rule.column).cast("double")
        usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.expr(rule.where)
        keys[f"_key{i}"] = F.when(usable, v if rule.side == "low" else -v)
    table = df.select(id_col, *carry, *[k.alias(name) for name, k in keys.items()], _sortable(df, id_col).alias("_id"))
    searches = [_Search(rule, F.col(f"_key{i}")) for i, rule in enumerate(rules)]
    ties: dict[int, tuple[int, int]] = {}
    open_ = searches
    while open_:
        _probe(table, open_, accuracy)
        open_ = [s for s in open_ if s.take]
        if open_:
            _count(table, open_, ties)
        open_ = [s for s in open_ if s.cut is None]
    _last_ids(table, searches, ties)

    entries = []
    for s in searches:
        if s.cut is None:  # no usable value
            continue
        member = s.key <= s.cut
        if s.last_id is not None:
            member = (s.key < s.cut) | ((s.key == s.cut) & (F.col("_id") <= s.last_id))
        value = s.key if s.rule.side == "low" else -s.key
        entries.append(F.when(member, F.struct(F.lit(s.rule.name).alias("rule"), value.alias("value"))))
    nothing = F.lit(None).cast("struct<rule:string,value:double>")
    found = table.select(id_col, *carry, F.explode(F.array_compact(F.array(nothing, *entries))).alias("_e"))
    return found.select("_e.rule", id_col, *carry, "_e.value")
