"""License scan as an exact set-similarity join between text blocks and license templates, in column expressions only.

A template of ``k`` words is compared with every block of ``2 k`` words of a text, whatever word it begins with. A block is found
when it contains at least the template's threshold of its distinct tokens. A block that begins with a word that the template does not
have holds no more than the one after it, so only those that begin with a template word are listed. Tokens are put in one global order, rarest in the whole corpus first (:func:`token_order` counts them):

* prefix filter: of a template's tokens in that order only the first ``size - needed + 1`` are looked up, since a block
  that has none of them holds too few. Only blocks that hold such a token are made at all.
* length filter: a block with fewer tokens than needed is no candidate.
* positional filter: a block's tokens behind the one that was looked up, in the same order, bound what can still agree.

Blocks that pass are verified on their whole token sets. Phrases are templates of threshold 1; where their words stand in
a row is checked in their blocks afterwards.

The templates are few and of fixed size, so their index is part of the expressions; documents are scanned where they lie,
nothing is shuffled but the token counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``phrase`` templates count only where all their words stand in a row."""

    label: str
    words: tuple[str, ...]
    threshold: float
    phrase: bool = False

    @property
    def tokens(self) -> set[str]:
        return set(self.words)

    @property
    def needed(self) -> int:
        return math.ceil(self.threshold * len(self.tokens) - 1e-9)


def phrase(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), 1.0, True)


def notice(label: str, text: str, threshold: float = 0.8) -> Template:
    return Template(label, tuple(text.split()), threshold)


# Phrases that name a license, and the opening words of common notices.
PHRASES = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)
NOTICES = (
    notice("apache-2.0", "licensed under the apache license version 2 0"),
    notice("gpl-3.0", "licensed under the gnu general public license version 3"),
    notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", 0.85),
    notice("mit-release", "released under the mit license"),
    notice("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    notice("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    notice("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters (lower-cased), digits and code points from 0x80 on; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def token_order(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> list[str]:
    """All template tokens, rarest in the whole of ``docs`` first. One row a template token reaches the driver."""
    vocabulary = sorted({t for template in templates for t in template.tokens})
    split = docs.select(words(F.col(text)).alias("w"))
    seen = split.select(F.explode(F.filter("w", lambda w: w.isin(vocabulary))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def find_blocks(docs: DataFrame, templates: tuple[Template, ...], text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` with ``words`` and ``blocks``: the blocks that meet a template's threshold.

    A block is (template, first, holds, starts): number of the template, first word, share of the template's tokens in the
    block and, for phrases, its first word again if the phrase stands there. Null and empty texts have no words and no blocks; repeated rows each get theirs; old ``words`` and ``blocks`` are replaced.
    """
    order = order if order is not None else token_order(docs, templates, text)
    rank = {t: i for i, t in enumerate(order)}
    sorted_ranks = [sorted(rank[t] for t in template.tokens) for template in templates]
    lookup: dict[str, list[tuple[int, int]]] = {}
    for number, (template, ranks) in enumerate(zip(templates, sorted_ranks)):
        for place, r in enumerate(ranks[: len(ranks) - template.needed + 1]):
            lookup.setdefault(order[r], []).append((number, place))
    keys = sorted(lookup)
    index = F.array(*[F.array(*[F.struct(F.lit(n).alias("t"), F.lit(p).alias("place")) for n, p in lookup[k]]) for k in keys])
    key_array = F.array(*[F.lit(k) for k in keys])
    vocabulary = F.array(*[F.lit(t) for t in order])
    length, size = _ints(len(t.words) for t in templates), _ints(len(t.tokens) for t in templates)
    needed, ranks_of = _ints(t.needed for t in templates), F.array(*[_ints(r) for r in sorted_ranks])
    tokens_of = F.array(*[F.array(*[F.lit(w) for w in sorted(t.tokens)]) for t in templates])
    phrases = F.array(*[F.array(*[F.lit(w) for w in (t.words if t.phrase else ())]).cast("array<string>") for t in templates])

    kept = [c for c in docs.columns if c not in ("words", "blocks")]
    step = docs.select(*kept, words(F.col(text)).alias("words"))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(keys), i)))
    step = step.select(*kept, "words", hits.alias("_hits"))

    def around(at: Column) -> Column:
        """The blocks that hold word ``at``, for each template that looks the word up, by their first words."""
        found = F.get(index, F.array_position(key_array, F.get("words", at)).cast("int") - 1)

        def starts(e: Column) -> Column:
            reach = F.sequence(F.greatest(at - 2 * F.get(length, e["t"]) + 1, F.lit(0)), at)
            return F.filter(reach, lambda s: F.array_contains(F.get(tokens_of, e["t"]), F.get("words", s)))

        return F.flatten(
            F.transform(found, lambda e: F.transform(starts(e), lambda s: F.struct(e["t"].alias("t"), e["place"].alias("place"), s.alias("first"))))
        )

    candidates = F.array_distinct(F.flatten(F.transform("_hits", around)))
    step = step.select(*kept, "words", candidates.alias("_candidates"))

    def with_tokens(c: Column) -> Column:
        k = F.get(length, c["t"])
        span = F.slice("words", c["first"] + 1, 2 * k)
        ranks = F.array_sort(F.array_distinct(F.filter(F.transform(span, lambda w: F.array_position(vocabulary, w).cast("int") - 1), lambda r: r >= 0)))
        return F.struct(c["t"].alias("t"), c["place"].alias("place"), c["first"].alias("first"), ranks.alias("ranks"))

    step = step.select(*kept, "words", F.transform("_candidates", with_tokens).alias("_blocks"))

    def possible(b: Column) -> Column:
        looked_up = F.get(F.get(ranks_of, b["t"]), b["place"])
        behind = F.size(b["ranks"]) - F.array_position(b["ranks"], looked_up).cast("int")
        bound = 1 + F.least(F.get(size, b["t"]) - 1 - b["place"], behind)
        return (F.size(b["ranks"]) >= F.get(needed, b["t"])) & (bound >= F.get(needed, b["t"]))

    def verified(b: Column) -> Column:
        common = F.size(F.array_intersect(b["ranks"], F.get(ranks_of, b["t"])))
        k = F.get(length, b["t"])
        stands = (F.size(F.get(phrases, b["t"])) > 0) & (F.slice("words", b["first"] + 1, k) == F.get(phrases, b["t"]))
        starts = F.when(stands, F.array(b["first"])).otherwise(F.array().cast("array<int>"))
        return F.struct(b["t"].alias("template"), b["first"].alias("first"), common.alias("common"), (common / F.get(size, b["t"])).alias("holds"), starts.alias("starts"))

    checked = F.array_distinct(F.transform(F.filter("_blocks", possible), verified))
    blocks = F.filter(checked, lambda b: b["common"] >= F.get(needed, b["template"]))
    return step.select(*kept, "words", blocks.alias("blocks"))


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: where phrases stand, the labels of phrases and notices, the best share of a template."""
    templates = (*phrases, *notices)
    found = find_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), templates, "text")
    labels = F.array(*[F.lit(t.label) for t in templates])
    placed = found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.flatten(F.transform("blocks", lambda b: b["starts"])).alias("starts"),
        F.transform(F.filter("blocks", lambda b: F.size(b["starts"]) > 0), lambda b: F.get(labels, b["template"])).alias("base"),
        F.transform(F.filter("blocks", lambda b: b["template"] >= len(phrases)), lambda b: F.get(labels, b["template"])).alias("own"),
        F.array_max(F.transform(F.filter("blocks", lambda b: (b["template"] >= len(phrases)) | (F.size(b["starts"]) > 0)), lambda b: b["holds"])).alias("best"),
    )
    joined = lambda parts: F.array_join(F.array_sort(F.array_distinct(parts)), ",")
    return placed.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "own")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
