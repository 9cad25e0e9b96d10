"""A stored index of terms for BM25 search, extended batch by batch.

Layout below one folder: ``postings/batch=<n>/bucket=<hash of the term>/`` and, written last, ``batches/batch=<n>/`` with the
number of documents and tokens; a batch without the second is not there yet for any reader, and a repeated batch replaces
itself. A posting block holds the documents of one term within one *region*, up to ``REGION`` neighbouring documents of a batch,
with its largest count and the least length per occurrence. The score grows with the one and falls with the other, so the best
score that the block can give is known for whatever length average and frequencies later batches bring.

A query lists only the buckets of its terms. For the best ``top`` documents, the regions with the highest possible sums are scored
first; every region that cannot reach the score of the last of them is skipped with all of its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.operators.search import query_terms, text_tokens

#: Documents of a region, and folders that terms are dealt to.
REGION = 1_024
BUCKETS = 64

#: A bound may be this much too low by rounding.
_SLACK = 1e-9


def field_tokens(docs: DataFrame, columns: Sequence[str]) -> Column:
    """The tokens of several columns, texts or lists of texts, one after the other; nulls have none."""
    parts = []
    for name in columns:
        listed = isinstance(docs.schema[name].dataType, T.ArrayType)
        text = F.array_join(name, " ") if listed else F.col(name)
        parts.append(text_tokens(F.coalesce(text, F.lit(""))))
    return F.concat(*parts)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def add_batch(docs: DataFrame, path: str, batch: int, id_col: str, columns: Sequence[str], buckets: int = BUCKETS, region: int = REGION) -> None:
    """Index ``docs`` as batch number ``batch``. Ids are unique over all batches; ``buckets`` is the same for all of them."""
    # neighbours in the input are neighbours in the index: row ids count up within a partition
    fields = [f"_c{i}" for i in range(len(columns))]
    numbered = docs.select(
        F.col(id_col).alias("id"), F.floor(F.monotonically_increasing_id() / region).alias("region"), *[F.col(c).alias(f) for c, f in zip(columns, fields)]
    )
    # whole texts move once, by region, which serves both groupings: they are far smaller than one row a term and document
    tokens = numbered.repartition("region").select("id", "region", field_tokens(numbered, fields).alias("_t"))
    counted = (
        tokens.select("id", "region", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
        .groupBy("region", "id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
    )
    rows = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))  # at most one region's documents
    blocks = (
        counted.groupBy("region", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min(F.col("dl") / F.col("tf")).alias("least_share"), rows.alias("rows"))
        .withColumn("bucket", _bucket(F.col("term"), buckets))
    )
    # a large bucket is written by several tasks and small ones share one; unlike ranges this needs no pass to find the cuts
    ordered = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "region")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(field_tokens(docs, columns))), F.lit(0)).alias("tokens"))
    sizes.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """One row a committed batch: ``batch``, ``docs``, ``tokens``, ``buckets``."""
    return spark.read.schema("docs long, tokens long, buckets int, batch long").parquet(f"{path}/batches")


def postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame | None:
    """The blocks of ``terms`` in committed batches; only their buckets are listed. None if there are none."""
    known = batches(spark, path).collect()  # one row a batch
    if not known:
        return None
    literal = F.array(*[F.lit(t) for t in terms])
    numbers = spark.range(1).select(F.transform(literal, lambda t: _bucket(t, known[0]["buckets"])).alias("b")).head()["b"]
    jvm = spark._jvm.org.apache.hadoop.fs
    chosen = "batch={" + ",".join(str(r["batch"]) for r in known) + "}/bucket={" + ",".join(str(b) for b in sorted(set(numbers))) + "}"
    pattern = jvm.Path(f"{path}/postings/{chosen}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    folders = [status.getPath().toString() for status in found or []]
    if not folders:
        return None
    return spark.read.option("basePath", f"{path}/postings").parquet(*folders).filter(F.col("term").isin(list(terms)))


def _ranked(blocks: DataFrame, terms: list[str], idf: list[float], average: float, k1: float, b: float) -> DataFrame:
    """``id`` and ``score`` of every document in the blocks."""
    each = blocks.select("term", F.explode("rows").alias("_r")).select("term", "_r.id", "_r.tf", "_r.dl")
    tfs = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
    score = F.lit(0.0)
    for i, weight in enumerate(idf):
        score = score + weight * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("dl") / average))
    return each.groupBy("id").agg(F.max("dl").alias("dl"), *tfs).select("id", score.alias("score"))


class Search:
    """One BM25 query over an index: frequencies and length average are those of all committed batches."""

    def __init__(self, spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75):
        self.spark, self.k1, self.b = spark, k1, b
        self.terms = sorted(set(query_terms(query)))
        if not self.terms:
            raise ValueError("empty query")
        self.blocks = postings(spark, path, self.terms)
        if self.blocks is None:
            return
        size = batches(spark, path).agg(F.sum("docs").alias("n"), F.sum("tokens").alias("tokens")).head()
        self.average = size["tokens"] / size["n"]
        found = {r[0]: r[1] for r in self.blocks.groupBy("term").agg(F.sum("n")).collect()}  # one row a term
        # as an expression and not in Python, to round like the scan of all texts does
        counts = F.array(*[F.lit(found.get(t, 0)).cast("long") for t in self.terms])
        n = size["n"]
        self.idf = spark.range(1).select(F.transform(counts, lambda df: F.log(1 + (n - df + 0.5) / (df + 0.5)))).head()[0]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string, score double")

    def scores(self) -> DataFrame:
        """``id`` and ``score`` of every document that has a term of the query."""
        return self._empty() if self.blocks is None else _ranked(self.blocks, self.terms, self.idf, self.average, self.k1, self.b)

    def regions(self) -> DataFrame:
        """``batch``, ``region`` and the highest score a document in it could have; reads no documents."""
        weights = F.create_map(*[F.lit(x) for pair in zip(self.terms, self.idf) for x in pair])
        bound = weights[F.col("term")] * (self.k1 + 1) / (1 + self.k1 * ((1 - self.b) / F.col("max_tf") + self.b * F.col("least_share") / self.average))
        return self.blocks.groupBy("batch", "region").agg((F.sum(bound) * (1 + _SLACK)).alias("bound"), F.sum("n").alias("postings"))

    def least_score(self, top: int) -> float:
        """A score that the ``top`` best documents all reach: that of the last of them within the most promising regions."""
        # each region has a document at least, so this many are enough
        best = self.regions().orderBy(F.col("bound").desc(), "batch", "region").limit(top)
        some = self.blocks.join(F.broadcast(best.select("batch", "region")), ["batch", "region"], "left_semi")
        scored = _ranked(some, self.terms, self.idf, self.average, self.k1, self.b)
        found = scored.orderBy(F.col("score").desc()).limit(top).agg(F.count(F.lit(1)), F.min("score")).head()
        return found[1] if found[0] == top else float("-inf")

    def kept_blocks(self, least: float) -> DataFrame:
        """The blocks of regions whose bound reaches ``least``."""
        kept = self.regions().filter(F.col("bound") >= least).select("batch", "region")
        return self.blocks.join(kept, ["batch", "region"], "left_semi")

    def best(self, top: int) -> DataFrame:
        """The ``top`` documents by score, ties by id: the same rows as the head of :meth:`scores`, from fewer blocks."""
        if self.blocks is None:
            return self._empty()
        scored = _ranked(self.kept_blocks(self.least_score(top)), self.terms, self.idf, self.average, self.k1, self.b)
        return scored.orderBy(F.col("score").desc(), "id").limit(top)
