"""One-word bloom filters of flags over Jenkins' one-at-a-time hash of their four bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _m(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def jenkins(value: Column | str) -> Column:
    """32-bit hash, as a long, of an unsigned 32-bit number in little-endian bytes (taken as signed characters)."""
    v = F.col(value) if isinstance(value, str) else value

    def byte(i: int) -> Column:
        b = F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("long"))
        return b - F.when(b > 127, F.lit(256).cast("long")).otherwise(F.lit(0).cast("long"))

    # One lambda variable for each step keeps the expression from doubling.
    start = F.struct(F.lit(0).cast("long").alias("h"))

    def step(acc: Column, b: Column) -> Column:
        h = _m(acc["h"] + b)
        h = _m(h + F.shiftleft(h, 10))
        return F.struct(h.bitwiseXOR(F.shiftright(h, 6)).alias("h"))

    def last(acc: Column) -> Column:
        h = _m(acc["h"] + F.shiftleft(acc["h"], 3))
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return _m(h + F.shiftleft(h, 15))

    return F.aggregate(F.array(*[byte(i) for i in range(4)]), start, step, last)


def bloom(values: Column) -> Column:
    """Aggregate: the OR of the hashes."""
    return F.bit_or(jenkins(values))


def bloom_check(word: Column, value: Column) -> Column:
    h = jenkins(value)
    return word.bitwiseAND(h) == h


def bloom_combine(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def crc32(content: Column | str) -> Column:
    """Checksum of a binary or text column, as a long."""
    return F.crc32(content)


def get_bit(word: Column, place: int) -> Column:
    return F.shiftrightunsigned(word, place).bitwiseAND(F.lit(1).cast("long"))


def set_bit(word: Column, place: int) -> Column:
    return word.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), place))


def clear_bit(word: Column, place: int) -> Column:
    return word.bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), place)))


def leading_zeros(word: Column) -> Column:
    """Of an unsigned 32-bit number: unset bits above its highest set one; 32 for 0."""
    return F.when(word == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(word))).cast("int")


def trailing_zeros(word: Column) -> Column:
    """Unset bits below its lowest set one; 32 for 0."""
    return F.when(word == 0, F.lit(32)).otherwise(F.length(F.bin(word)) - F.length(F.rtrim(F.bin(word), F.lit("0")))).cast("int")
