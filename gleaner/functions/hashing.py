"""FNV-1a with 64 bits: natively over halves of 32 bits, as there is no unsigned long, and in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = (1 << 32) - 1


def fnv1a(data: bytes, seed: int = 0) -> int:
    h = OFFSET ^ seed
    for byte in data:
        h = (h ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_halves(text: Column, seed: int = 0) -> Column:
    """struct(hi, lo) of longs: the hash of a string's UTF-8; null for null.

    The prime is 2^40 + 0x1B3, so that a product of halves stays within a long.
    """
    start = OFFSET ^ seed
    data = text.cast("binary")
    size = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        mixed = h["lo"].bitwiseXOR(byte(i))
        product = mixed * 435
        high = h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    first = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & _LOW).cast("long").alias("lo"))
    return F.when(text.isNotNull(), F.aggregate(places, first, step))


def modulo(halves: Column, n: int) -> Column:
    """The unsigned hash modulo n."""
    return ((halves["hi"] % n) * ((1 << 32) % n) + halves["lo"]) % n


def hex_digits(halves: Column) -> Column:
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.concat(half(halves["hi"]), half(halves["lo"]))


def fnv1a_sql(text: str, seed: int = 0) -> str:
    """DuckDB SQL of the unsigned hash of a string expression, a HUGEINT."""
    start = OFFSET ^ seed
    bytes_of = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS HUGEINT))"
    return f"list_reduce(list_concat([{start}::HUGEINT], {bytes_of}), lambda h, b: (xor(h, b) * {PRIME}::HUGEINT) % 18446744073709551616::HUGEINT)"
