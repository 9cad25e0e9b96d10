"""The registered query of each operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverprint.llm import decontaminate, domain_scores, fingerprints, licenses, mixing, near_dups, oracles, prefix_trie, quality_rank, shards, simple8b, surrogates, word_bpe, word_runs
from silverprint.llm.registry import ORACLES, QUERIES, query, table
from silverprint.operators.ranking import global_rank
from silverprint.workspace import new_table_path

__all__ = ["ORACLES", "QUERIES"]

#: Key of the registered query; a real run passes a secret of its own.
SURROGATE_KEY = b"surrogates of the registered query"

#: Shards of the registered query.
SHARDS = 24


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, which every executor has at the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontamination", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op2_word_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), stored=True)


@query("op3_license_scan", oracles.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # whole documents are dealt; size and digest are those of the rows that arrive
    return shards.shuffle_into(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_domain_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return domain_scores.score_own(docs, good)


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", "n_entities")


@query("op8_near_duplicates", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_quality_rank")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality_rank.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rank.score(docs, ranking).select(
        "doc_id",
        (quality_rank.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality_rank.CUT_SCORE).cast("int").alias("predicted"),
    )


@query("op10_simple8b")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "tokens")
    simple8b.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return simple8b.read_tokens(spark, path, digest=True)


#: Weights of the sources of the registered mix, in order of their names, again and again.
MIX_WEIGHTS = (3, 1, 2)


@query("op11_source_mix")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ranked = global_rank(docs.select("source").distinct(), [F.col("source").asc_nulls_last()])
    turn = (F.col("rank") - 1) % len(MIX_WEIGHTS)
    weights = ranked.select("source", F.element_at(F.array(*map(F.lit, MIX_WEIGHTS)), (turn + 1).cast("int")).alias("weight"))
    return mixing.mix(docs, weights).select("doc_id", "size", "source_size", "target", "taken")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by their id, repeat a stretch of their words up to the end; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size("_w")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    copied = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, words))
    return chosen.select("doc_id", F.when(F.size("_w") > 0, F.array_join(copied, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_word_runs", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.collapse_runs(_with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_r", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_r.start")).alias("start"),
        F.col("_r.length").alias("length"),
        (-F.col("_r.period")).alias("period"),
        F.expr("1000 * _r.length div -_r.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Conversations of this many ids in a row open like the first of them.
SIBLINGS = 20


def _rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations by turn (ties by role, then digest); each opens with up to three turns of the first one of its siblings.

    Turns without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length keeps role and text apart
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)).cast("long")
    row = F.struct("turn", role.alias("role"), key.alias("key"), words.alias("words"))
    own = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    # null turns come first
    own = own.select("conv_id", F.concat(F.filter("_t", lambda t: t["turn"].isNull()), F.filter("_t", lambda t: t["turn"].isNotNull())).alias("_t"))
    own = own.select("conv_id", F.transform("_t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))
    first = own.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, 3).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    joined = own.withColumn("_first", F.col("conv_id") - F.col("conv_id") % SIBLINGS).join(first, "_first", "left")
    opening = F.slice(F.coalesce("_head", F.filter("turns", lambda t: F.lit(False))), F.lit(1), h)
    return joined.select("conv_id", F.concat(opening, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


@query("op13_prefix_trie", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(_rebuilt(table(spark, sf_dir, "conversations")))
