"""Text shown to people: byte sizes, counts, plurals and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024.0


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def fmt_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal above B."""
    v = n.cast("double")
    return (
        F.when(v < KIB, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(v < KIB**2, F.concat(_fixed(v / KIB, 1), F.lit(" KB")))
        .when(v < KIB**3, F.concat(_fixed(v / KIB**2, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(v / KIB**3, 1), F.lit(" GB")))
    )


def human_bytes(n: Column, guard: bool = False) -> Column:
    """Bytes as B to TB, no decimal in B or from 100 up; ``guard`` turns bad input into ``0 B``."""
    v = n.cast("double")

    def scaled(power: int, unit: str) -> Column:
        x = v / KIB**power
        return F.concat(F.when(x >= 100, _fixed(x, 0)).otherwise(_fixed(x, 1)), F.lit(f" {unit}"))

    text = (
        F.when(v < KIB, F.concat(_fixed(v, 0), F.lit(" B")))
        .when(v < KIB**2, scaled(1, "KB"))
        .when(v < KIB**3, scaled(2, "MB"))
        .when(v < KIB**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )
    if not guard:
        return text
    bad = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    return F.when(bad, F.lit("0 B")).otherwise(text)


def hero_bytes(n: Column) -> Column:
    """Headline size: GB from 1 GiB up, else MB; no decimal from 100 up."""
    gb = n.cast("double") / KIB**3
    mb = n.cast("double") / KIB**2

    def shown(x: Column) -> Column:
        return F.when(x >= 100, _fixed(x, 0)).otherwise(_fixed(x, 1))

    return F.when(gb >= 1, F.concat(shown(gb), F.lit(" GB"))).otherwise(F.concat(shown(mb), F.lit(" MB")))


def fmt_count(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def group_label(filename: Column) -> Column:
    """Readable name of a duplicate group: extension off, separators to blanks, 36 characters."""
    bare = F.regexp_replace(filename, r"\.[^.]+$", "")
    return F.substring(F.regexp_replace(bare, "[_-]", " "), 1, 36)


def natural_key(name: Column) -> Column:
    """Sort text for file names: no case, no accents, digit runs compared as numbers."""
    # a run of digits without leading zeros, its length in front: longer numbers are larger
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(p)

    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.collate(F.array_join(F.transform(parts, part), ""), "UNICODE_CI_AI")


def json_text(*columns: Column) -> Column:
    """One JSON object; 64-bit numbers must be passed as strings by the caller."""
    return F.to_json(F.struct(*columns))
