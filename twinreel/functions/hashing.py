"""Perceptual hashes as 64-bit words: packing, distances, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash: sides of the transform and of the kept corner, bits.
DCT_SIDE, HASH_SIDE, HASH_BITS = 16, 10, 1000
HASH_WORDS = 16
#: Tolerances: of the library, of the command line.
LIBRARY_TOLERANCE, CLI_TOLERANCE = 0.35, 0.3


def pack_signs(values: Column, bits: int = 64) -> Column:
    """Bits ``value > 0`` of up to 64 values, the first one lowest."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get(values, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
    )


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Bits that differ, summed over the words."""
    total = F.bit_count(left[0].bitwiseXOR(right[0]))
    for a, b in zip(left[1:], right[1:], strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def normalised(distance: Column, scale: int = HASH_BITS) -> Column:
    return distance / F.lit(float(scale))


def bit_list(words: Column, bits: int = HASH_BITS) -> Column:
    """The single bits of an array of words, lowest first."""
    word = lambda i: F.get(words, F.floor(i / 64).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", word(i), i % 64).bitwiseAND(F.lit(1)).cast("int"))


def tolerance_bits(tolerance: float, scale: int = HASH_BITS) -> int:
    """A tolerance of 0 to 1 as whole bits, cut off."""
    return int(tolerance * scale)


def self_band_end(duration: Column) -> Column:
    """Longest duration that a leader of this duration claims."""
    return (duration.cast("double") * F.lit(1.1)).cast("int")


def reference_band(duration: Column) -> tuple[Column, Column]:
    """Shortest and longest duration that a reference of this duration finds."""
    return (duration.cast("double") * F.lit(0.95)).cast("int"), (duration.cast("double") * F.lit(1.05)).cast("int")


def band_bin(duration: Column) -> Column:
    """Logarithmic bins, one for each tenth more."""
    return F.floor(F.log(duration + F.lit(1.0)) / F.log(F.lit(1.1))).cast("int")
