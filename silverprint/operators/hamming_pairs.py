"""Pairs of 64-bit hashes within a Hamming distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.hashing import hamming
from silverprint.operators.components import thin_edges
from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import global_rank
from silverprint.schema import NO_DHASH
from silverprint.workspace import materialise, release

# Largest distance of a near duplicate, and rows compared after each row.
HAMMING_LIMIT = 6
RANK_WINDOW = 64


def near_candidates(items: DataFrame, library: str | None = None) -> DataFrame:
    """Images with a usable hash, optionally of one library."""
    kept = items.filter((F.col("kind") == "IMAGE") & F.col("dhash_hex").isNotNull() & (F.col("dhash_hex") != NO_DHASH))
    return kept if library is None else kept.filter(F.col("library_id") == library)


def rank_by_hash(items: DataFrame) -> DataFrame:
    """Candidates numbered in hash order (hex text, then id)."""
    return global_rank(items, [F.col("dhash_hex"), F.col("media_id")], "rank")


def near_window_pairs(ranked: DataFrame, limit: int = HAMMING_LIMIT, window: int = RANK_WINDOW) -> DataFrame:
    """Pairs less than ``window`` ranks apart with different content and distance up to ``limit``.

    Ranks are cut into buckets of ``window`` rows. A row can only meet its own and the next bucket,
    so the range join becomes an equi-join on buckets that all have the same size.
    """
    slim = ranked.select("rank", "media_id", "sha256", "dhash")
    bucket = ((F.col("rank") - F.pmod("rank", F.lit(window))) / window).cast("long")
    left = slim.select(
        *[F.col(c).alias(f"{c}_a") for c in slim.columns],
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
    )
    right = slim.select(*[F.col(c).alias(f"{c}_b") for c in slim.columns], bucket.alias("bucket"))
    gap = F.col("rank_b") - F.col("rank_a")
    distance = hamming(F.col("dhash_a"), F.col("dhash_b"))
    return (
        left.join(right, "bucket")
        .filter((gap >= 1) & (gap < window) & (F.col("sha256_a") != F.col("sha256_b")) & (distance <= limit))
        .select("bucket", "rank_a", "rank_b", "media_id_a", "media_id_b", distance.alias("distance"))
    )


def near_window_links(ranked: DataFrame, limit: int = HAMMING_LIMIT, window: int = RANK_WINDOW) -> DataFrame:
    """Edges ``(rank_a, rank_b)`` with the same components as the window pairs.

    A bucket sees at most two windows of rows, so a run of very many equal hashes gives at most two
    links per row instead of one per pair.
    """
    return thin_edges(near_window_pairs(ranked, limit, window), "rank_a", "rank_b")


def hash_groups(items: DataFrame) -> DataFrame:
    """One row per distinct hash with the range of content digests and the first item."""
    return items.groupBy("dhash").agg(
        F.min("sha256").alias("sha_lo"), F.max("sha256").alias("sha_hi"), F.count(F.lit(1)).alias("copies")
    )


def _cut_points(bits: int, pieces: int) -> list[tuple[int, int]]:
    """Start and length of ``pieces`` nearly equal runs covering ``bits`` bits."""
    edges = [round(i * bits / pieces) for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(length: int) -> int:
    return (1 << length) - 1


def _band(value: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit(_mask(length)))


def band_keys(hashes: DataFrame, limit: int = HAMMING_LIMIT) -> DataFrame:
    """``(dhash, key)``, one row per band of each hash; hashes within the distance share at least one key."""
    cuts = _cut_points(64, limit + 1)
    digit = max(length for _, length in cuts)
    keys = [F.shiftleft(F.lit(i).cast("long"), digit).bitwiseOR(_band(F.col("dhash"), *cut)) for i, cut in enumerate(cuts)]
    return hashes.select("dhash", F.explode(F.array(*keys)).alias("key"))


def _without(value: Column, start: int, length: int) -> Column:
    """``value`` with the run of bits taken out and the upper part moved down."""
    below = value.bitwiseAND(F.lit(_mask(start)))
    if start + length >= 64:
        return below
    return F.shiftleft(F.shiftrightunsigned(value, start + length), start).bitwiseOR(below)


def _slim(groups: DataFrame) -> DataFrame:
    """``(dhash, content, mixed)``: two hashes of one content each hold the same one if their ``content`` is equal.

    Band rows are many times the hashes, so they carry the smallest hash of a content in place of its digest.
    """
    held = materialise(groups.select("dhash", "sha_lo", "sha_hi", (F.col("sha_lo") != F.col("sha_hi")).alias("mixed")), "hash_contents")
    contents = held.filter("NOT mixed").groupBy("sha_lo").agg(F.min("dhash").alias("content"))
    sizes = held.filter("sha_lo IS NOT NULL").groupBy("sha_lo").agg(F.count(F.lit(1)).alias("n"))
    named = attach_facts(held, contents.join(sizes, "sha_lo"), ["sha_lo"], F.col("n"), "dhash", keep_unmatched=True)
    slim = materialise(named.select("dhash", "content", "mixed"), "slim_hashes")
    release(held)
    return slim


def _expand(level: DataFrame, depth: int, bits: int, limit: int, digit: int, carried: tuple[str, ...] = ("content", "mixed")) -> DataFrame:
    """One row per band of the remaining bits: the band is appended to the key and cut out.

    What remained at level 1 and deeper is kept as ``rest_1`` and so on; at level 0 it is the hash.
    """
    rest = F.col("rest")
    bands = [
        F.struct(
            F.lit(i).cast("long").alias("no"),
            _band(rest, start, length).alias("value"),
            _without(rest, start, length).alias("rest"),
        )
        for i, (start, length) in enumerate(_cut_points(bits, limit + 1))
    ]
    step = F.shiftleft(F.col("_b.no"), digit - 4).bitwiseOR(F.col("_b.value"))
    return level.withColumn("_b", F.explode(F.array(*bands))).select(
        "dhash",
        *carried,
        F.shiftleft(F.col("key"), digit).bitwiseOR(step).alias("key"),
        *[f"rest_{d}" for d in range(1, depth)],
        *([rest.alias(f"rest_{depth}")] if depth else []),
        F.col("_b.rest").alias("rest"),
    )


def _layout(limit: int, levels: int) -> tuple[int, int, int]:
    """Bits of a hash, bits that a level adds to the key, and how many levels a key has room for."""
    if not 1 <= limit <= 15:
        raise ValueError("limit must be between 1 and 15")
    digit = 4 + max(length for _, length in _cut_points(64, limit + 1))
    return 64, digit, min(levels, 63 // digit)


def near_banded_pairs(
    groups: DataFrame, limit: int = HAMMING_LIMIT, crowded: int = 1024, levels: int = 4, links_only: bool = False
) -> DataFrame:
    """All pairs of distinct hashes at distance 1 to ``limit``, with full recall, each pair once.

    Cutting 64 bits into ``limit`` + 1 bands, two close hashes agree in at least one band: an
    equi-join on (band, value) finds them. Values held by more than ``crowded`` hashes are not
    joined but cut again over their remaining bits, where the same argument holds, so the key gets
    longer exactly where the data is dense. Copies of one hash are one row here (``hash_groups``).
    With ``links_only`` the pairs of a value are thinned to links with the same components.
    """
    bits, digit, levels = _layout(limit, levels)
    level = _slim(groups).select("dhash", "content", "mixed", F.lit(0).cast("long").alias("key"), F.col("dhash").alias("rest"))
    found, widths = None, []
    for depth in range(levels):
        widths.append(bits)
        keyed = _expand(level, depth, bits, limit, digit)
        shortest = min(length for _, length in _cut_points(bits, limit + 1))
        bits -= shortest
        last = depth == levels - 1 or bits < 2 * (limit + 1)
        bounded = not last
        if not last:
            keyed = materialise(keyed, "bands")
            crowds = materialise(
                keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > crowded).select("key"),
                "crowds",
            )
            last = crowds.isEmpty()
        calm = keyed if last else keyed.join(crowds, "key", "left_anti")
        pairs = _join_bands(calm, limit, widths, digit)
        if links_only and bounded:
            pairs = thin_edges(pairs, "dhash_a", "dhash_b")
        else:
            pairs = pairs.select("dhash_a", "dhash_b", *([] if links_only else ["distance"]))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        level = keyed.join(crowds, "key", "left_semi")
    return found


def _first_band(widths: list[int], limit: int, digit: int) -> Column:
    """Whether the key of a pair is the first band in which it agrees, at every level."""
    rests = ["dhash", *[f"rest_{depth}" for depth in range(1, len(widths))]]
    first = F.lit(True)
    for depth, bits in enumerate(widths):
        above = digit * (len(widths) - 1 - depth)
        no = F.shiftrightunsigned(F.col("key"), above + digit - 4).bitwiseAND(F.lit(15).cast("long"))
        difference = F.col(f"{rests[depth]}_a").bitwiseXOR(F.col(f"{rests[depth]}_b"))
        for i, (start, length) in enumerate(_cut_points(bits, limit + 1)):
            first = first & ((no <= i) | (_band(difference, start, length) != 0))
    return first


def _join_bands(keyed: DataFrame, limit: int, widths: list[int], digit: int) -> DataFrame:
    """Join on the key; a pair counts only in the first band in which it agrees, at every level."""
    shared = ("dhash", *[f"rest_{depth}" for depth in range(1, len(widths))], "content", "mixed")
    left = keyed.select("key", *[F.col(c).alias(f"{c}_a") for c in shared])
    right = keyed.select("key", *[F.col(c).alias(f"{c}_b") for c in shared])
    distance = hamming(F.col("dhash_a"), F.col("dhash_b"))
    differ = F.col("mixed_a") | F.col("mixed_b") | (F.col("content_a") != F.col("content_b"))
    return (
        left.join(right, "key")
        .filter((F.col("dhash_a") < F.col("dhash_b")) & (distance <= limit) & differ & _first_band(widths, limit, digit))
        .select("key", "dhash_a", "dhash_b", distance.alias("distance"))
    )


def near_asked_pairs(
    keyed: DataFrame, limit: int = HAMMING_LIMIT, crowded: int = 1024, levels: int = 4, stored: Callable[[DataFrame, str], DataFrame] = materialise
) -> DataFrame:
    """``(dhash_a, dhash_b)`` at distance 1 to ``limit`` of hashes that ask with hashes that are told, with full recall.

    ``keyed`` holds ``(dhash, key, asks, told)``: rows of ``band_keys`` of either kind or of both at once. A value that more than
    ``crowded`` hashes ask for is cut again as in :func:`near_banded_pairs`, so a row that is told meets at most ``crowded`` in a
    band, however many hashes there are. Two hashes that are of both kinds are one pair. ``stored`` writes a scratch table.
    """
    bits, digit, levels = _layout(limit, levels)
    no = F.shiftrightunsigned("key", digit - 4)
    without = [F.when(no == i, _without(F.col("dhash"), *cut)) for i, cut in enumerate(_cut_points(bits, limit + 1))]
    keyed = stored(keyed, "asked_bands").withColumn("rest", F.coalesce(*without))
    found, widths = None, []
    for depth in range(levels):
        widths.append(bits)
        bits -= min(length for _, length in _cut_points(bits, limit + 1))
        last = depth == levels - 1 or bits < 2 * (limit + 1)
        if not last:
            asked = keyed.filter("asks").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            crowds = stored(asked.filter(F.col("size") > crowded).select("key"), "crowds")
            last = crowds.isEmpty()
        pairs = _join_asked(keyed if last else keyed.join(crowds, "key", "left_anti"), limit, widths, digit)
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        level = keyed.join(crowds, "key", "left_semi")
        keyed = stored(_expand(level, depth + 1, bits, limit, digit, ("asks", "told")), "asked_bands")
    return found


def _join_asked(keyed: DataFrame, limit: int, widths: list[int], digit: int) -> DataFrame:
    """Rows that ask with rows that are told of the same key, counted in the first band in which they agree."""
    shared = ("dhash", *[f"rest_{depth}" for depth in range(1, len(widths))])
    left = keyed.filter("asks").select("key", F.col("told").alias("both_a"), *[F.col(c).alias(f"{c}_a") for c in shared])
    right = keyed.filter("told").select("key", F.col("asks").alias("both_b"), *[F.col(c).alias(f"{c}_b") for c in shared])
    a, b = F.col("dhash_a"), F.col("dhash_b")
    once = (a < b) | ((a != b) & ~(F.col("both_a") & F.col("both_b")))
    # few rows make very many products: they lie side by side in a merge join, a broadcast table is searched for each of them
    met = left.join(right.hint("merge"), "key")
    return met.filter(once & (hamming(a, b) <= limit) & _first_band(widths, limit, digit)).select("dhash_a", "dhash_b")
