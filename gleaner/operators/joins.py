"""Ordered and prefix joins as windows and equi-joins: nearest before, nearest within reach, longest prefix with wildcards."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: str, name: str | None = None) -> DataFrame:
    """rows with the value of the last mark of the same keys at or before them, null without one.

    Both sides are one timeline for each key, in order of place, marks first; of marks at
    one place the greatest value counts. Null places match nothing; a null key is a key.
    """
    name = name or value
    columns = [F.struct(*[F.col(c) for c in rows.columns]).alias("__row"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("__value"), F.lit(1).alias("__side")]
    left = rows.select(*keys, F.col(at).alias("__at"), *columns)
    right = marks.where(F.col(mark_at).isNotNull()).select(*keys, F.col(mark_at).alias("__at"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"), F.lit(0).alias("__side"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).withColumn("__seen", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    return seen.select(*[F.col("__row").getField(c).alias(c) for c in rows.columns], F.when(F.col("__at").isNotNull(), F.col("__seen")).alias(name))


def nearest(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, reach: int, name: str = "mark") -> DataFrame:
    """rows with the place of the nearest mark of the same keys, at most ``reach`` away, the one before on a tie, else null."""
    before = as_of(rows, marks, keys, at, mark_at, mark_at, "__before")
    flipped = marks.select(*keys, (-F.col(mark_at)).alias("__turned"))
    both = as_of(before.withColumn("__at", -F.col(at)), flipped, keys, "__at", "__turned", "__turned", "__after").drop("__at")
    back, forth = F.col(at) - F.col("__before"), -F.col("__after") - F.col(at)
    near = F.when(back.isNotNull() & (back <= reach) & (forth.isNull() | (back <= forth)), F.col("__before")).when(forth <= reach, -F.col("__after"))
    return both.withColumn(name, near).drop("__before", "__after")


def wildcard_keys(prefixes: DataFrame, prefix: str, wildcard: str = "x", most: int = 4) -> DataFrame:
    """prefixes with __key: each wildcard stands for any digit, and each prefix becomes all the keys that it means; at most 10 ** most of them."""

    def longer(keys: Column, k: int) -> Column:
        sign = F.substring(F.col(prefix), k, 1)
        digits = F.when(sign == wildcard, F.array(*[F.lit(str(d)) for d in range(10)])).otherwise(F.array(sign))  # behind the end an empty one
        return F.flatten(F.transform(keys, lambda left: F.transform(digits, lambda right: F.concat(left, right))))

    keys: Column = F.array(F.lit(""))
    for k in range(1, most + 1):
        keys = longer(keys, k)
    return prefixes.where((F.length(prefix) >= 1) & (F.length(prefix) <= most)).withColumn("__key", F.explode(keys))


def prefix_join(rows: DataFrame, prefixes: DataFrame, number: str, prefix: str, wildcard: str = "x", most: int = 4) -> DataFrame:
    """rows with the columns of the longest prefix that their number begins with, of equally long ones the least; inner join, equi on keys of up to ``most`` digits."""
    own = [c for c in prefixes.columns if c != prefix]
    best = wildcard_keys(prefixes, prefix, wildcard, most).groupBy("__key").agg(F.min(F.struct(prefix, *own)).alias("__p"))
    lengths = F.array(*[F.lit(k) for k in itertools.islice(itertools.count(1), most)])
    keyed = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__n", F.explode(lengths)).where(F.length(number) >= F.col("__n"))
    met = keyed.withColumn("__key", F.expr(f"substring(`{number}`, 1, __n)")).join(best, "__key")
    found = met.groupBy("__row").agg(F.max(F.struct("__n", "__p", F.struct(*[F.col(c) for c in rows.columns]).alias("__of"))).alias("m"))
    return found.select(*[F.col("m.__of").getField(c).alias(c) for c in rows.columns], F.col("m.__p").getField(prefix).alias(prefix), *[F.col("m.__p").getField(c).alias(c) for c in own])
