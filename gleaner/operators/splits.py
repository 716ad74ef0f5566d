"""Deterministic splits, quotas and samples by hashes of keys; no random state, so reruns and lost tasks agree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import fnv1a_halves, modulo


def mixed_key(seed: int, *columns: Column) -> Column:
    """An order that looks random: md5 of seed and columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def split_12(key: Column, seed: int = 0) -> Column:
    """train for ten of twelve buckets, valid and test for one each."""
    bucket = modulo(fnv1a_halves(key, seed), 12)
    return F.when(bucket == 10, "valid").when(bucket == 11, "test").otherwise("train")


def split_100(key: Column, seed: int = 0) -> Column:
    """train for ninety of a hundred buckets, valid and test for five each."""
    bucket = modulo(fnv1a_halves(key, seed), 100)
    return F.when(bucket < 90, "train").when(bucket < 95, "valid").otherwise("test")


def keep_some(name: Column, per_mille: int) -> Column:
    """Whether a name is among the share of per_mille that stays."""
    return modulo(fnv1a_halves(name, 0x9E37), 1000) < per_mille


def first_of(rows: DataFrame, groups: list[str], order: list[str], n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each group by a total order.

    Ranked within hashed parts of a group first, so that no task ranks more than parts * n
    rows of a large one.
    """
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    for by in ([*groups, "__part"], groups):
        salted = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n)
    return salted.drop("__part", "__rank")


def quotas(rows: DataFrame, groups: list[str], order: list[str], quota: int, place_only: Column | None = None, share: float = 0.15) -> DataFrame:
    """The first ``quota`` rows of each group by order, of which at most a share are place-only."""
    if place_only is None:
        return first_of(rows, groups, order, quota)
    marked = rows.withColumn("__place", place_only)
    places = first_of(marked.where("__place"), groups, order, -(-int(quota * share * 1000) // 1000))
    return first_of(marked.where("not __place").unionByName(places), groups, order, quota).drop("__place")


def uncovered(rows: DataFrame, groups: list[str], quota: int) -> DataFrame:
    """(groups, n) of groups that have fewer rows than the quota."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n")).where(F.col("n") < quota)


def equal_shares(rows: DataFrame, group: str, id_col: str, total: int, seed: int = 0) -> DataFrame:
    """total rows with equal shares of groups, what small groups leave filled up in hashed order."""
    mixed = rows.withColumn("__mix", mixed_key(seed, F.col(id_col)))
    n = max(1, rows.select(group).distinct().count())
    ranked = first_of(mixed, [group], ["__mix", id_col], total)
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy("__mix", id_col)))
    later = F.when(F.col("__rank") <= total // n, 0).otherwise(1)
    return ranked.orderBy(later, "__mix", id_col).limit(total).drop("__mix", "__rank")


def hash_sample(rows: DataFrame, group: str, id_col: str, n: int, seed: str = "") -> DataFrame:
    """n rows of each group by sha256 of seed, group and id."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(id_col).cast("string")), 256)
    return first_of(rows.withColumn("__digest", digest), [group], ["__digest", id_col], n).drop("__digest")


def capped_selection(rows: DataFrame, group: str, id_col: str, caps: dict[str, int], total: int, seed: str = "") -> DataFrame:
    """In hashed order within each group: rows until one of their cap columns is used up, at most total.

    The order matters, so that a group is one task's, but the task reads it as a sorted
    stream and remembers counts alone: of kept rows' values, so total of each at most.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(id_col).cast("string")), 256)
    columns = rows.columns
    at, places = columns.index(group), {columns.index(c): n for c, n in caps.items()}

    def choose(batches):
        now, kept, used = object(), 0, {}
        for b in batches:
            values = {i: b.column(i).to_pylist() for i in (at, *places)}
            keep = []
            for k in range(b.num_rows):
                if values[at][k] != now:
                    now, kept, used = values[at][k], 0, {}
                own = [(i, values[i][k]) for i in places]
                fits = kept < total and all(used.get(x, 0) < places[x[0]] for x in own)
                keep.append(fits)
                if fits:
                    kept += 1
                    used.update({x: used.get(x, 0) + 1 for x in own})
            yield b.filter(pa.array(keep, pa.bool_()))

    ordered = rows.withColumn("__digest", digest).repartition(group).sortWithinPartitions(group, "__digest", id_col).select(*columns)
    return ordered.mapInArrow(choose, rows.schema)


def mixed_passes(rows: DataFrame, stratum: str, id_col: str, seed: int = 0) -> DataFrame:
    """rows with a turn: strata take turns round by round, each row once, in hashed order."""
    order = Window.partitionBy(stratum).orderBy(mixed_key(seed, F.col(stratum), F.col(id_col)), id_col)
    ranked = rows.withColumn("__round", F.row_number().over(order))
    return ranked.withColumn("turn", F.struct(F.col("__round").alias("round"), mixed_key(seed, F.col("__round"), F.col(stratum)).alias("mix"))).drop("__round")


def rotating_views(rows: DataFrame, views: DataFrame, parent: str, presentation: str, view_no: str = "view_no") -> DataFrame:
    """Each presentation of a parent with the view that stands in for it: odd ones take turns, even ones have none."""
    counted = views.groupBy(parent).agg(F.count("*").alias("__n"))
    turn = F.when(F.col(presentation) % 2 == 1, F.pmod(F.floor(F.col(presentation) / 2), F.col("__n")).cast("int"))
    return rows.join(counted, parent, "left").withColumn(view_no, turn).join(views, [parent, view_no], "left").drop("__n")
