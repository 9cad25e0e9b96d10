"""Perceptual-hash expressions on 64-bit values and their 16-digit hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(text: Column) -> Column:
    """16 hex digits to a signed 64-bit value; the upper half of the range wraps to negative."""
    return F.conv(text, 16, -10).cast("long")


def hash_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def gradient_hash(values: Column, bits: int = 63) -> Column:
    """Hash of the signs of neighbouring differences, first comparison in the highest bit used."""
    rises = F.zip_with(
        F.slice(values, 1, bits), F.slice(values, 2, bits), lambda a, b: F.when(a < b, F.lit("1")).otherwise(F.lit("0"))
    )
    return F.conv(F.array_join(rises, ""), 2, -10).cast("long")
