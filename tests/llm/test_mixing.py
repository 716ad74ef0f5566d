import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.integers(1, 60))), None, ["a", "b", "c", "d", None][int(rng.choice(5, p=[0.5, 0.2, 0.15, 0.1, 0.05]))]) for i in range(n)]


EDGES = [(1000, None, None, "a"), (1001, "", None, "b"), (1002, "\x0bone\ttwo three", None, "a"), (None, "no id", None, "a"), (1003, "twice", None, "z"), (1003, "twice", None, "z"), (1004, "", None, "empty")]


def water_level(sizes):
    """Targets by the definition: reshare the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_names = 1.5 * sum(sizes.values()), {}, list(names)
    while open_names:
        total = sum(weight[s] for s in open_names)
        full = [s for s in open_names if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_names}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_names = [s for s in open_names if s not in full]
    return target


def test_targets_sizes_and_taken(docs):
    rows = corpus() + EDGES
    found = mixing.report(docs(rows)).collect()
    assert len(found) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes = {}
    for i, _, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size[i]
    want, taken, source_of = water_level(sizes), {}, {r[0]: r[3] for r in rows}
    for r in found:
        s = source_of[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60


def test_reruns_agree_and_oracle(docs):
    rows = corpus(seed=3) + EDGES[:5]
    one, two = (sorted(map(tuple, mixing.report(docs(rows).repartition(n)).collect()), key=str) for n in (1, 5))
    assert one == two
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    assert sorted((tuple(r) for r in con.sql(mixing.ORACLE).fetchall()), key=str) == one


def test_mix_takes_what_the_report_says(docs):
    rows = corpus()
    made = docs(rows)
    mixed = mixing.mix(made, shards=8)
    assert mixed.columns == made.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(made, shards=8).collect() if r["taken"]}
    assert counts == want
    per_shard = mixed.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(per_shard) > 1


def test_shards_follow_the_words(docs, monkeypatch):
    monkeypatch.setattr(mixing, "FILE_WORDS", 40)
    monkeypatch.setattr(mixing, "BLOCKS", 20)
    made = docs(corpus())
    mixed = mixing.mix(made)
    assert mixed.rdd.getNumPartitions() > 100
    assert sum(r["taken"] // r["size"] for r in mixing.report(made).collect() if r["taken"]) == mixed.count()


def by_shard(spark, q, shards, seed=0):
    found = mixing.split(spark.createDataFrame(list(enumerate(q)), "place long, n long"), shards, seed).collect()
    out = np.zeros((shards, len(q)), int)
    for r in found:
        assert r["n"] > 0
        out[r["shard"], r["place"]] += r["n"]
    return out


def test_split_adds_up_and_is_even(spark):
    q = [1000, 300, 50, 0, 7]
    for shards in (1, 2, 5, 16):
        found = by_shard(spark, q, shards)
        assert found.sum(axis=0).tolist() == q
        assert np.ptp(found.sum(axis=1)) <= max(1, np.log2(shards))


def test_split_equals_a_tree_by_hand(spark):
    from hashlib import md5
    from math import comb

    def uniform(*key):
        return int(md5("/".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52

    def node(low, high, q):
        if high - low == 1:
            return {low: q}
        middle, total = (low + high) // 2, sum(q)
        rest, drawn, left = total, total * (middle - low) // (high - low), []
        for i, m in enumerate(q):
            u, upto, k = uniform(3, low, high, i), 0.0, max(0, drawn + m - rest) - 1
            while upto < u and k < min(m, drawn):
                k += 1
                upto += comb(m, k) * comb(rest - m, drawn - k) / comb(rest, drawn)
            left.append(k)
            rest, drawn = rest - m, drawn - k
        return node(low, middle, left) | node(middle, high, [a - b for a, b in zip(q, left)])

    q = [40, 0, 13, 7, 25]
    want = node(0, 6, q)
    assert by_shard(spark, q, 6, 3).tolist() == [want[i] for i in range(6)]


def test_split_of_many_sources_in_rows_of_few(spark, monkeypatch):
    q = [17, 4, 0, 9, 60, 1, 1, 30, 2, 8]
    one = by_shard(spark, q, 5)
    monkeypatch.setattr(mixing, "SOURCES_A_ROW", 3)
    found = by_shard(spark, q, 5)
    assert found.sum(axis=0).tolist() == one.sum(axis=0).tolist() == q
    assert found.sum(axis=1).tolist() == one.sum(axis=1).tolist()


def test_shards_of_rows_are_those_that_the_tree_deals(docs):
    rows = corpus(600, seed=5)
    found = mixing.report(docs(rows)).collect()
    source, per = {r[0]: r[3] for r in rows}, {}
    for r in found:
        shards = [int(x) for x in r["shards"].split(",") if x]
        assert shards == sorted(shards) and r["taken"] == r["size"] * len(shards) and all(0 <= x < mixing.SHARDS for x in shards)
        for x in shards:
            per.setdefault(source[r["doc_id"]], [0] * mixing.SHARDS)[x] += r["size"]
    for words in per.values():  # every source is in its share of shards
        assert sum(w > 0 for w in words) > 8


def test_hypergeometric_quantiles(spark):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = sorted(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(30), u).alias("k")).collect())
    want = sorted(np.random.default_rng(0).hypergeometric(25, 35, 30, 200_000))[25::50]
    assert np.mean(got) == pytest.approx(12.5, abs=0.01) and np.abs(np.array(got) - np.array(want)).mean() < 0.1


def test_empty_table(docs):
    assert mixing.report(docs([])).count() == 0
    assert mixing.mix(docs([])).count() == 0
