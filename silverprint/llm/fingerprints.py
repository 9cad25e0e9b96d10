"""One-permutation MinHash fingerprints in column expressions only.

Every shingle (five words in a row; fewer words make one shingle) is hashed once. The top bits of the hash name one of
``BINS`` bins and a bin keeps its smallest hash, so sorting the hashes puts each bin's minimum first. An empty bin takes the
minimum of a bin that a hash of its own number points to: up to ``PROBES`` bins are tried, then the fullest choice is made
among the bins that hold something, by the smallest hash of both numbers. All documents use the same choices, so bins of
two documents agree with the probability of their Jaccard similarity (optimal densification).

Of each bin the low ``8`` bits of a hash over its minimum and its number are kept. Unequal minima agree by chance once in
256, which :func:`likeness` takes out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A power of two; the standard error of a likeness of one half is 0.5 / sqrt(BINS).
BINS = 256
SHINGLE = 5
PROBES = 12
_SHIFT = 64 - (BINS.bit_length() - 1)
_CHANCE = 1 / 256


def _bin(value: Column) -> Column:
    return (F.shiftright(value, _SHIFT) + BINS // 2).cast("int")


def with_fingerprint(df: DataFrame, text: str, column: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as ``BINS`` signed bytes; a text without words has an empty one.

    Null counts as empty. The steps are separate projections because each is used several times by the next.
    """
    kept = [c for c in df.columns if c != column]
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")
    step = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))

    def shingle_at(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *[F.get("_w", i + j) for j in range(1, shingle)])

    many = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - (shingle - 1), F.lit(0))), shingle_at)
    few = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*kept, F.sort_array(F.when(F.size("_w") >= shingle, many).otherwise(few)).alias("_h"))
    lowest = F.filter("_h", lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get("_h", i - 1), _SHIFT)))
    step = step.select(*kept, lowest.alias("_m"))
    none = F.lit(None).cast("bigint")
    gaps = F.transform(
        "_m",
        lambda h, i: F.concat(F.array_repeat(none, _bin(h) - 1 - F.when(i > 0, _bin(F.get("_m", i - 1))).otherwise(-1)), F.array(h)),
    )
    bins = F.concat(F.flatten(gaps), F.array_repeat(none, BINS - 1 - _bin(F.element_at("_m", -1))))
    step = step.select(*kept, "_m", F.when(F.size("_m") > 0, bins).otherwise(F.array().cast("array<bigint>")).alias("_b"))

    def filled(value: Column, i: Column) -> Column:
        probes = [F.get("_b", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        choice = F.array_min(F.transform("_m", lambda m: F.struct(F.xxhash64(i, _bin(m)).alias("by"), m.alias("m"))))
        return F.coalesce(value, *probes, choice["m"])

    dense = F.when(F.size("_m") == BINS, F.col("_b")).otherwise(F.transform("_b", filled))
    packed = F.transform(F.col("_d"), lambda v, i: (F.xxhash64(v, i).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    return step.select(*kept, dense.alias("_d")).select(*kept, packed.alias(column))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1, without the share of chance agreement.

    Two empty fingerprints are alike, an empty one is like no other.
    """
    agreed = F.size(F.filter(F.col(a), lambda x, i: x == F.get(b, i))) / BINS
    unbiased = F.greatest(F.lit(0.0), (agreed - _CHANCE) / (1 - _CHANCE))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(unbiased)


def as_text(fingerprint: str) -> Column:
    """The packed bytes in hexadecimal."""
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
    return F.array_join(F.transform(F.col(fingerprint), lambda x: F.get(digits, x.cast("int") + 128)), "")


def with_following(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the row after it in descending order of ``key``; after the last comes the first.

    Rows are dealt to as many ranges of ``key`` as the session has shuffle partitions. The greatest row of each range is
    also sent to the range above it, where it follows that range's last row, so each range finds its own answers and rows
    move once. Rows without key come last, equal keys are ordered by ``tie``.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.select(at.alias("k")).agg(F.percentile_approx("k", shares or [0.5], 100 * ranges).alias("cuts")).first()
    cuts = sorted(set(found.cuts or []))
    stride = max(1, int(len(cuts) ** 0.5))
    pages = [cuts[i : i + stride] for i in range(0, len(cuts), stride)]

    def literal(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    # the page whose first cut is the last one not above the key, then the place in that page
    page = F.size(F.filter(literal([p[0] for p in pages]), lambda c: c <= F.col("_k"))) if pages else F.lit(0)
    inside = F.size(F.filter(F.get(F.array(*[literal(p) for p in pages]), F.col("_page") - 1), lambda c: c <= F.col("_k"))) if pages else F.lit(0)
    place = F.when(F.col("_page") == 0, 0).otherwise((F.col("_page") - 1) * stride + inside)
    ranged = df.withColumn("_k", at).withColumn("_page", page).withColumn("_range", place.cast("int")).drop("_page")
    tops = sorted(ranged.groupBy("_range").agg(F.max("_k").alias("k")).collect())  # one row a range
    sent = [(tops[i].k, tops[i + 1]._range, 1) for i in range(len(tops) - 1)]
    if tops:
        sent.append((tops[-1].k, tops[0]._range, 1))
    guests = spark.createDataFrame(sent, "_k long, _to int, _guest int")
    guest_rows = (
        ranged.join(F.broadcast(guests), "_k", "left")
        .withColumn("_in", F.explode(F.when(F.col("_guest").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("g"))))))
        .select(*df.columns, "_k", F.col("_in.r").alias("_range"), F.col("_in.g").alias("_guest"))
    )
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_k"), tie)
    led = guest_rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.filter("_guest = 0").drop("_k", "_range", "_guest")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint and that of its edited text, whose last third is the beginning of the next document.

    ``near_edited`` is the likeness of the two, ``near_next`` that of the document and the next one, in descending order of
    ids. Null counts as empty; equal texts have equal fingerprints whatever else is in the table.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(source, "text", "print")
    paired = with_following(own, "doc_id", "text", ["text", "print"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = paired.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)).alias("edited"),
        "print",
        "next_print",
    )
    printed = with_fingerprint(edited.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_print")
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("print").alias("fingerprint"),
        as_text("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
    )
