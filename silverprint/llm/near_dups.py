"""Near duplicates by bottom-k sketches: one hash function, inverted lists, union sketches, exact Jaccard.

A document's set is its distinct 5-word shingles. The ``k`` smallest of their hashes are its sketch. Two sets with
a Jaccard similarity of ``t`` share ``k * t`` retained values on average; a pair that shares less than
``retained_share * k`` of them is 4.6 standard deviations off at ``t`` itself, far more above it, and is not looked for. A
larger ``k`` makes that rarer still (6.5 at 128), at twice the sketches.

1. Documents of equal sets become one node (their smallest id): copies are never paired.
2. Every retained value is looked up by how many nodes hold it. A pair that shares at least
   ``ceil(retained_share * s)`` of its ``s`` values shares one of the ``s - that + 1`` rarest, whatever the order, so
   only those enter the inverted lists. Values of a passage that very many documents share come last in that
   order and make no list of their own.
3. Each list is compared with its most central node only, so a group of thousands of near copies costs one pair a
   node. The bottom-k of the union of two sketches estimates their similarity and drops pairs far below ``t``.
4. Full sets confirm what is left. Lists whose nodes are then in one component are done; in the others all pairs of
   nodes from different components are tried if the list is short. In a long one most nodes are ruled out first, by what
   they share with the centre and with anyone else (see ``_long_list_pairs``).
5. Components of the links name the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.llm.texts import SpanHasher, as_bytes, chained, map_rows, plain_words
from silverprint.operators.components import connected_components
from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise, release

SHINGLE = 5
THRESHOLD = 75
K = 64
RETAINED_SHARE = 0.5
#: Standard deviations by which an estimate may be off.
SIGMAS = 5
#: Nodes of an inverted list all of whose pairs may be tried, and of one block of a longer one.
SHORT = 32
BLOCK = 64


def shingle_sets(texts: list[bytes | None], hasher: SpanHasher, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle of all of them.

    A hash mixes the hashes of its words, which mix all their bytes: two given shingles agree by chance once in 2^64.
    """
    rows = [plain_words(t) for t in texts]
    buffer = b" ".join(w for words in rows for w in words)
    lengths = np.fromiter((len(w) for words in rows for w in words), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    made = np.maximum(counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    word_at = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(word_at[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    words = hasher.hashes(buffer, starts, ends)
    hashes = chained(words, first, np.repeat(np.minimum(counts, size), made)).view(np.int64)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    hasher = SpanHasher()

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(as_bytes(batch.column("text")), hasher)
        offsets = np.concatenate([[0], np.cumsum([min(len(s), k) for s in sets])]).astype(np.int32)
        values = np.concatenate([s[:k] for s in sets]) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())),
            ],
            ["id", "n", "digest", "sketch"],
        )

    return map_rows(docs, sketch, "id long, n long, digest binary, sketch array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    hasher = SpanHasher()

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(as_bytes(batch.column("text")), hasher)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))], ["node", "set"]
        )

    return map_rows(docs, sets_of, "node long, set array<long>")


def _beside(pairs: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """Pairs with ``value`` of both ends as ``value_a`` and ``value_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
    return pairs


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the bottom-k of the union that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = F.size(F.array_intersect("set_a", "set_b"))
    return _beside(pairs, sets, "set").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).drop("set_a", "set_b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD, k: int = K, retained_share: float = RETAINED_SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    ``component_id`` is the smallest id that links reach, ``kept`` is true where it is the document's own. A null or
    empty text and one of white space has no shingle and no link. A document without id is linked to nothing, has a
    null component and is kept. Rows that repeat an id and a text each get their row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    described = _sketches(source, k)
    linkable = described.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    nodes = materialise(
        linkable.groupBy("digest")
        .agg(F.min(F.struct("id", "n", "sketch")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("digest", "copies", F.col("first.id").alias("node"), F.col("first.n").alias("n"), F.col("first.sketch").alias("sketch")),
        "nodes",
    )
    written: list[DataFrame] = []
    labels = connected_components(_links(source, nodes, percent, k, retained_share, written), "a", "b")
    for table in written:  # the components are a table of their own
        release(table)
    named = nodes.select("digest", "node", "copies").join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id"), "copies"
    )
    # texts of one digest are one node, so the digest alone is enough to find a document's component
    rows = _digests(source)
    found = attach_facts(rows, named, ["digest"], F.col("copies"), "id", keep_unmatched=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _digests(source: DataFrame) -> DataFrame:
    """Set size and digest only; made anew from the texts, which is cheaper than keeping all sketches."""
    return _sketches(source, 0).select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))


def _links(source: DataFrame, nodes: DataFrame, percent: int, k: int, retained_share: float, written: list[DataFrame]) -> DataFrame:
    """Links with the same components as all links between nodes; scratch tables are added to ``written``."""

    def stored(df: DataFrame, label: str) -> DataFrame:
        written.append(materialise(df, label))
        return written[-1]

    target = percent / 100
    slack = SIGMAS * (target * (1 - target) / k) ** 0.5
    size = F.size("sketch")
    prefix = size - F.ceil(retained_share * size).cast("int") + 1
    values = nodes.select("node", prefix.alias("prefix"), size.alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    ranked = (
        values.join(shared, "value")
        .groupBy("node", "prefix", "size")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("held"))
        # values that no other node holds are the rarest and fill the prefix first
        .withColumn("open", F.col("prefix") - (F.col("size") - F.size("held")))
        .filter("open > 0")
    )
    lists = stored(
        ranked.select(
            "node",
            F.aggregate("held", F.lit(0).cast("long"), lambda total, h: total + h.holders).alias("central"),
            F.explode(F.slice("held", 1, F.col("open"))).alias("entry"),
        ).select("node", "central", F.col("entry.value").alias("value")),
        "lists",
    )
    centres = (
        lists.groupBy("value")
        .agg(F.max(F.struct("central", (-F.col("node")).alias("back"))).alias("top"), F.count(F.lit(1)).alias("holders"))
        .filter("holders > 1")
        .select("value", (-F.col("top.back")).alias("centre"), "holders")
    )
    placed = stored(
        attach_facts(lists, centres, ["value"], F.col("holders"), "node").select("value", "node", "centre", "holders"), "placed"
    )
    sets = stored(
        _full_sets(source.join(placed.select(F.col("node").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])), "sets"
    )
    sketches = nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "sketch")

    def estimated(pairs: DataFrame) -> DataFrame:
        likeness = _estimate(F.col("sketch_a"), F.col("sketch_b"), k)
        return _beside(pairs, sketches, "sketch").select("a", "b", likeness.alias("likeness"))

    possible = F.col("likeness") >= target - slack

    to_centre = placed.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    likeness = stored(estimated(to_centre), "likeness")
    first = stored(_confirmed(likeness.filter(possible).select("a", "b"), sets, percent), "first_links")

    component = connected_components(first, "a", "b")
    labelled = placed.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
    ).filter("low <> high and n > 2")
    open_lists = stored(attach_facts(labelled, mixed.select("value", "n"), ["value"], F.col("n"), "node"), "open_lists")
    rest = _short_list_pairs(open_lists.filter(F.col("n") <= SHORT), likeness, first, target, slack).unionByName(
        _long_list_pairs(open_lists.filter(F.col("n") > SHORT), sets, percent, stored)
    )
    tried = stored(rest.distinct(), "tried")
    second = _confirmed(estimated(tried).filter(possible).select("a", "b"), sets, percent)
    return first.select("a", "b").unionByName(second.select("a", "b"))


def _short_list_pairs(members: DataFrame, likeness: DataFrame, first: DataFrame, target: float, slack: float) -> DataFrame:
    """All pairs of nodes from different components in lists of at most ``SHORT`` nodes, but for the centre's own."""
    ends = [F.col("a").alias("centre"), F.col("b").alias("node")]
    # role: 0 the centre's own links, 1 neither, 2 too far from the centre for a link to any of them
    reach = max(0.0, 2 * target - 1 - slack)
    role = F.when(F.col("linked"), 0).when(F.col("likeness") >= reach, 1).otherwise(2)
    judged = (
        members.filter("node <> centre")
        .join(first.select(*ends, F.lit(True).alias("linked")), ["centre", "node"], "left")
        .join(likeness.select(*ends, "likeness"), ["centre", "node"], "left")
        .select("value", "node", "component", role.alias("role"))
    )
    return (
        judged.alias("l")
        .join(judged.alias("r"), "value")
        .filter("l.node < r.node and l.component <> r.component and abs(l.role - r.role) < 2")
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    )


def _long_list_pairs(members: DataFrame, sets: DataFrame, percent: int, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs of one centre's long lists that can still be links, without pairing a list with itself.

    Nodes that the centre links are in its component, so one of a pair is a node that it does not link. What two nodes
    share is at most what the centre shares with the poorer of them, plus what the poorer holds outside the centre and
    some other node holds too. A node whose share stays too small even for the smallest partner goes before any pair is
    made; of a group of near copies this leaves those on the edge of the threshold, and of documents with one common
    passage none. Those left meet the whole group in blocks of bounded size.
    """
    grouped = members.select("centre", "node", "component").distinct()
    own = sets.join(grouped.select("node").union(grouped.select("centre")).distinct(), "node", "left_semi")
    each = own.select("node", F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("shingle")
    held = each.join(often, "shingle").groupBy("node").agg(F.collect_list("shingle").alias("held"))
    of_centre = own.select(F.col("node").alias("centre"), F.col("set").alias("core"))
    described = stored(
        grouped.filter("node <> centre")
        .join(own.join(held, "node", "left"), "node")
        .join(of_centre, "centre")
        .select(
            "centre",
            "node",
            "component",
            F.size("set").alias("n"),
            F.size("core").alias("core"),
            F.size(F.array_intersect("set", "core")).alias("inside"),
            F.coalesce(F.size(F.array_except("held", "core")), F.lit(0)).alias("outside"),
        ),
        "described",
    )

    def enough(shared: Column, a: Column, b: Column) -> Column:
        return 100 * shared >= percent * (a + b - shared)

    least = described.groupBy("centre").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))
    # tables of their own: what follows reads each several times
    alive = stored(
        attach_facts(described, least, ["centre"], F.col("size"), "node").filter(
            enough(F.col("inside") + F.col("outside"), F.col("n"), F.least(F.col("least"), F.col("inside") + F.col("outside")))
            | enough(F.col("inside") + F.col("outside"), F.col("n"), F.col("least"))
        ),
        "alive",
    )
    loose = alive.filter(~enough(F.col("inside"), F.col("n"), F.col("core")))
    blocks = stored(
        loose.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("loose")),
        "blocks",
    )
    spread = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    left = attach_facts(loose, blocks, ["centre"], F.col("loose"), "node").withColumn("block", spread)
    right = attach_facts(alive, blocks, ["centre"], F.col("loose"), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = F.least("l.inside", "r.inside") + F.least("l.outside", "r.outside")
    return (
        left.alias("l")
        .join(right.alias("r"), ["centre", "block"])
        .filter((F.col("l.component") != F.col("r.component")) & enough(F.least(shared, F.col("l.n"), F.col("r.n")), F.col("l.n"), F.col("r.n")))
        .select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    )
