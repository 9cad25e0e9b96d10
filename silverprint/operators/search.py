"""Token index, lexical, semantic and hybrid search."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.vectors import dot_with
from silverprint.operators.keyed import single
from silverprint.workspace import materialise

# Results kept by semantic search, and the score they must exceed.
SEMANTIC_TOP = 60
SEMANTIC_MIN = 0.15
# The usual constant of reciprocal rank fusion.
FUSION_CONSTANT = 60


def tokenize(filename: Column, min_length: int = 3) -> Column:
    bare = F.regexp_replace(F.lower(filename), r"\.[^.]+$", "")
    return F.filter(F.split(bare, r"[\s_\-./]+"), lambda t: F.length(t) >= min_length)


def token_index(view: DataFrame) -> DataFrame:
    """Distinct ``(token, uid)`` rows."""
    return view.select(F.explode(tokenize(F.col("filename"))).alias("token"), "uid").distinct()


def lexical_match(query: str, filename: Column, tags: Column | None = None, *texts: Column) -> Column:
    """Whole query as a substring of the name, a tag or another text, ignoring case."""
    q = query.lower().strip()
    hit = F.lower(filename).contains(q)
    if tags is not None:
        hit = hit | F.coalesce(F.exists(tags, lambda t: t.contains(q)), F.lit(False))
    for text in texts:
        hit = hit | F.lower(F.coalesce(text, F.lit(""))).contains(q)
    return hit


def search_uid_resolve(hits: DataFrame, view: DataFrame) -> DataFrame:
    """The first photo (smallest id) of every hit uid, so byte-identical copies show once."""
    first = view.groupBy("uid").agg(F.min("id").alias("id"))
    return hits.select("uid").distinct().join(first, "uid")


def semantic_search(
    items: DataFrame, query: Sequence[float], top: int = SEMANTIC_TOP, min_score: float = SEMANTIC_MIN
) -> DataFrame:
    """The ``top`` items by dot product with the query, of which those above ``min_score`` stay."""
    scored = items.filter(F.size("embedding") > 0).select("media_id", dot_with(F.col("embedding"), query).alias("score"))
    return scored.orderBy(F.col("score").desc(), "media_id").limit(top).filter(F.col("score") > min_score)


def search_fallback(view: DataFrame, semantic: DataFrame | None, query: str) -> DataFrame:
    """Semantic hits if there are any, else the exact whole-query token, else substrings."""
    q = query.lower().strip()
    tokens = token_index(view).filter(F.col("token") == q)
    by_token = search_uid_resolve(tokens, view).select("id", F.lit(2).alias("tier"))
    by_text = view.filter(lexical_match(q, F.col("filename"))).select("id", F.lit(3).alias("tier"))
    found = by_token.unionByName(by_text)
    if semantic is not None:
        found = semantic.select(F.col("media_id").alias("id"), F.lit(1).alias("tier")).unionByName(found)
    best = found.agg(F.min("tier").alias("t")).scalar()
    return found.filter(F.col("tier") == best)


def text_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: F.length(t) > 0)


def lexical_search(docs: DataFrame, query: str, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over whole texts.

    The texts are read once: what is kept of each is its length and its counts of the query terms,
    and this small table serves both the corpus statistics and the scores.
    """
    terms = sorted({t for t in query_terms(query)})
    if not terms:
        raise ValueError("empty query")
    tokens = docs.select(id_col, text_tokens(F.col(text_col)).alias("_t"))
    counts = [F.size(F.filter("_t", _equals(term))) for term in terms]
    measured = materialise(tokens.select(id_col, F.size("_t").alias("dl"), F.array(*counts).alias("tf")), "terms")
    stats = measured.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dl").alias("avgdl"),
        F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"),
    )
    joined = measured.filter(F.exists("tf", lambda x: x > 0)).withColumn("_s", single(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("tf")[i], F.col("_s.df")[i]
        idf = F.log(1 + (F.col("_s.n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("_s.avgdl")))
    return joined.select(id_col, score.alias("score"))


def _equals(term: str):
    return lambda token: token == term


def query_terms(query: str) -> list[str]:
    """The tokens of a query, cut like those of the texts: letters and decimal digits stay together."""
    letters = (c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in query.lower())
    return "".join(letters).split()


def hybrid_search(lexical: DataFrame, semantic: DataFrame, id_col: str = "media_id", top: int = SEMANTIC_TOP) -> DataFrame:
    """Reciprocal rank fusion of two whole scored lists; ids are unique within a list.

    A row that is among the first ``top`` of a list scores at least ``1 / (c + top)``. A row beyond place ``c + 2 * top`` in
    both lists scores less than ``2 / (2 * c + 2 * top)``, so only rows before that place in either list can be in the
    result. For these few the exact place in the other list is counted: every task finds where its rows fall among them.
    """
    depth = FUSION_CONSTANT + 2 * top
    lists = {"lexical_rank": lexical.select(id_col, "score"), "semantic_rank": semantic.select(id_col, "score")}
    heads = [rows.orderBy(F.col("score").desc(), id_col).limit(depth).select(id_col) for rows in lists.values()]
    candidates = sorted({r[0] for head in heads for r in head.collect()})  # at most 2 * depth rows
    spark = lexical.sparkSession
    wanted = spark.createDataFrame([(c,) for c in candidates], lexical.select(id_col).schema)
    places: dict[str, dict] = {}
    for name, rows in lists.items():
        found = rows.join(F.broadcast(wanted), id_col).collect()
        keys = sorted((-r["score"], r[id_col]) for r in found)
        before = _counts_before(rows, id_col, keys)
        places[name] = {key[1]: 1 + n for key, n in zip(keys, np.cumsum(before).tolist())}
    fused = [(c, places["lexical_rank"].get(c), places["semantic_rank"].get(c)) for c in candidates]
    kind = lexical.schema[id_col].dataType.simpleString()
    table = spark.createDataFrame(fused, f"{id_col} {kind}, lexical_rank int, semantic_rank int")

    def part(name: str) -> Column:
        return F.coalesce(1.0 / (FUSION_CONSTANT + F.col(name)), F.lit(0.0))

    return (
        table.withColumn("score", part("lexical_rank") + part("semantic_rank"))
        .orderBy(F.col("score").desc(), id_col)
        .limit(top)
    )


def _counts_before(rows: DataFrame, id_col: str, keys: list[tuple]) -> list[int]:
    """How many rows come before the first key, and between each key and the next."""

    scores = np.array([k[0] for k in keys], np.float64)
    ids = np.array([k[1] for k in keys], object)

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, found_ids = -batch["score"].to_numpy(np.float64), batch[id_col].to_numpy(object)
            first, place = np.searchsorted(scores, found, "left"), np.searchsorted(scores, found, "right")
            level = np.flatnonzero(first < place)  # rows with the score of some key are placed by id among these keys
            for start in np.unique(first[level]):
                rows_here = level[first[level] == start]
                keys_here = slice(start, place[rows_here[0]])
                place[rows_here] = start + np.searchsorted(ids[keys_here], found_ids[rows_here], "right")
            where, n = np.unique(place, return_counts=True)
            yield pd.DataFrame({"place": where, "n": n}, dtype="int64")

    summed = rows.mapInPandas(fall, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r.place: r.n for r in summed}
    # a row equal to key k falls on place k + 1, so what lies before key k are places 0 to k
    return [found.get(k, 0) for k in range(len(keys))]


def unit(vector: Sequence[float]) -> list[float]:
    length = math.sqrt(sum(float(x) * float(x) for x in vector)) or 1.0
    return [float(x) / length for x in vector]
