"""Approximate nearest neighbours by inner product: inverted lists scanned a block of dimensions at a time.

The adaptive dimension scan rotates vectors at random, so that the first dimensions of a
difference are a sample of all of them, and gives a candidate up as soon as a hypothesis
test on its partial distance says that it can't be among the nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, first_of_groups, materialise, unpack, vectors

#: Rows that lists, probes and first bounds are fitted on: this many, or SAMPLE_A_LIST for each list, up to MOST_SAMPLE; every row is indexed.
SAMPLE, SAMPLE_A_LIST, MOST_SAMPLE = 8192, 8, 65_536
#: Lists, at most; there are as many as the root of the number of rows.
MOST_LISTS = 8192
#: Rows of a list that one task scans together; larger lists are dealt by a hash.
BLOCK_ROWS = 8192
#: Rows of a list between two bounds.
SLICE = 1024
#: Queries that a task meets with them, at most about so many.
QUERY_BLOCK = 16_384


@dataclass
class Index:
    """Largest inner product as least distance: vectors get a last component sqrt(bound - |x|^2), queries a zero."""

    bound: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray
    sample_ids: list[list[int]]
    probes: int
    step: int = 16
    strictness: float = 2.5

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.bound - (x * x).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Squared distances to centroids, but for what is the same for all of them."""
        return (self.centroids**2).sum(axis=1) - 2 * lifted @ self.centroids.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self.distances(self.lift(x)).argmin(axis=1)

    def probe(self, q: np.ndarray) -> np.ndarray:
        d = self.distances(np.column_stack([q, np.zeros(len(q))]))
        return np.argsort(d, axis=1, kind="stable")[:, : self.probes]

    def radius(self, q: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which k vectors other than the query itself are sure to be; infinite if the sample is too small."""
        if len(self.sample) <= k:
            return np.full(len(q), np.inf)
        best = -np.partition(-(q @ self.sample.T), k, axis=1)[:, k]
        return (q * q).sum(axis=1) + self.bound - 2 * best

    def scan(self, x: np.ndarray, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that outlast every test."""
        xr, qr = self.lift(x) @ self.rotation, np.column_stack([q, np.zeros(len(q))]) @ self.rotation
        width, end = xr.shape[1], min(self.step, xr.shape[1])
        partial = (qr[:, :end] ** 2).sum(axis=1)[:, None] + (xr[:, :end] ** 2).sum(axis=1) - 2 * qr[:, :end] @ xr[:, :end].T
        i, j = np.nonzero(self.passes(partial, radius[:, None], end, width))
        partial = partial[i, j]
        while end < width and len(i):
            at, end = end, min(end + self.step, width)
            d = qr[i, at:end] - xr[j, at:end]
            partial = partial + (d * d).sum(axis=1)
            on = self.passes(partial, radius[i], end, width)
            i, j, partial = i[on], j[on], partial[on]
        return i, j

    def tighten(self, q: np.ndarray, reps: np.ndarray, radius: np.ndarray, best: pa.Table, k: int) -> None:
        """Lowers the radius of queries of which k hits are known to the distance of the k-th."""
        rep, score = best["rep"].to_numpy(), best["score"].to_numpy()  # by query, best first
        full = np.flatnonzero(rep[k - 1 :] == rep[: max(0, len(rep) - k + 1)])
        order = np.argsort(reps)
        i = order[np.searchsorted(reps, rep[full], sorter=order)]
        reach = (q[i] ** 2).sum(axis=1) + self.bound - 2 * score[full + k - 1]
        radius[i] = np.minimum(radius[i], reach)

    def passes(self, partial: np.ndarray, radius: np.ndarray, seen: int, width: int) -> np.ndarray:
        slack = 1.0 if seen == width else (1 + self.strictness / np.sqrt(seen)) ** 2
        return partial * (width / seen) <= radius * slack + 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, sample_ids: list[list[int]], bound: float, n: int, k: int, coverage: float = 0.97, seed: int = 1) -> Index:
    """Lists for n rows, fitted on a sample, and as many probes as cover the neighbours of sampled rows within the sample.

    Nearer neighbours, as all rows offer them, are in nearer lists, so that coverage is at
    least that over all rows.
    """
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    index = Index(bound, rotation, np.zeros((1, d)), sample, sample_ids, 1)
    lifted = index.lift(sample)
    lists = max(1, min(MOST_LISTS, len(sample), round(np.sqrt(n))))
    index.centroids = kmeans(lifted, lists, seed=seed)
    own, some = index.distances(lifted).argmin(axis=1), np.arange(min(len(sample), 512))
    q = sample[some]
    score = q @ sample.T
    score[some, some] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    rank = np.argsort(np.argsort(index.distances(np.column_stack([q, np.zeros(len(q))])), axis=1), axis=1)
    places = rank[some[:, None], own[top]]
    index.probes = min(lists, int(np.quantile(places, coverage, method="higher")) + 1)
    return index


_ROW = pa.schema([("list", pa.int32()), ("rep", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])
_PROBE = pa.schema([("list", pa.int32()), ("rep", pa.int64()), ("vector", pa.binary()), ("radius", pa.float64())])
_HIT = pa.schema([("rep", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])


def best_rows(q: np.ndarray, reps: np.ndarray, x: np.ndarray, ids: list[list[int]], i: np.ndarray, j: np.ndarray, k: int) -> pa.Table:
    """The k best rows of each query among pairs (i, j), where vector j of x stands for all of ids[j]."""
    score = (q[i] * x[j]).sum(axis=1)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    reach, every_id = np.cumsum(sizes) - sizes, np.array([v for own in ids for v in own], np.int64)
    times = sizes[j]
    who = np.repeat(np.arange(len(i)), times)
    at = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(reach[j], times)
    qi, sc, vi = i[who], score[who], every_id[at]
    order = np.lexsort((vi, -sc, qi))
    qi, sc, vi = qi[order], sc[order], vi[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return pa.table([pa.array(reps[qi[best]]), pa.array(sc[best]), pa.array(vi[best])], schema=_HIT)


def kept(hits: pa.Table, k: int) -> pa.Table:
    """The k best hits of each query, ties to smaller ids."""
    rep, score, vec_id = (hits[c].to_numpy() for c in ("rep", "score", "vec_id"))
    order = np.lexsort((vec_id, -score, rep))
    at = rep[order]
    return hits.take(pa.array(order[np.arange(len(at)) - np.searchsorted(at, at) < k]))


def search(embeddings: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", coverage: float = 0.97) -> DataFrame:
    """The k vectors of largest inner product found for each query: (query_id, rank, vec_id, score).

    Queries are the rows whose id is divisible by ``every``, candidates all rows but a
    query's own; ranks from 1, ties to smaller ids; scores are inner products of the
    original vectors in double precision. Fewer candidates give fewer rows. Vectors null,
    zero or holding null or non-finite components take no part, nor do null ids; a vector
    shorter than the longest one has zeros behind it; several rows of one id are one if
    their vectors are equal. Empty tables give no rows; other columns are not read.

    Equal vectors are one in the index, with their k + 1 least ids: no others can be among
    anyone's nearest, as ties go to the smaller. Large lists are dealt by a hash, and so are
    the queries that probe a list, so that neither side of a task grows with the table.

    A query scans its nearest list first. The k + 1 best found there bound its scan of the
    others, and in every list each slice of rows bounds the next, so that the share of
    candidates that outlasts the first dimensions falls as lists grow.
    """
    spark = embeddings.sparkSession
    base = materialise(vectors(embeddings, id_col, vector_col).distinct(), "vectors")
    few = first_of_groups(base, ["vector"], ["vec_id"], k + 1)
    distinct = materialise(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids"), "distinct")
    n = distinct.count()
    if not n:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")

    def norms(batches):
        for b in batches:
            x = unpack(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())] if len(x) else [], pa.float64())], names=["bound"])

    bound = distinct.select("vector").mapInArrow(norms, "bound double").agg(F.max("bound")).first()[0]
    size = max(SAMPLE, min(MOST_SAMPLE, SAMPLE_A_LIST * round(n**0.5)))
    picked = distinct.orderBy(F.xxhash64("rep"), "rep").limit(size).collect()
    index = spark.sparkContext.broadcast(fit(np.array([np.frombuffer(r["vector"], "<f8") for r in picked]), [r["ids"] for r in picked], bound * (1 + 1e-9), n, k, coverage))

    def assign(batches):
        for b in batches:
            at = index.value.assign(unpack(b.column(1))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], schema=_ROW)

    rows = materialise(distinct.mapInArrow(assign, "list int, rep long, vector binary, ids array<long>"), "lists")
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    parts = F.broadcast(materialise(parts, "parts"))  # at most MOST_LISTS rows
    rows = rows.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")

    asked = base.where(F.col("vec_id") % every == 0).join(distinct.select("vector", "rep"), "vector").select("vec_id", "rep")
    asked = materialise(asked, "asked")
    wanted = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")

    def lists_of(batches):
        """How many queries probe each list."""
        total = np.zeros(MOST_LISTS, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                total += np.bincount(index.value.probe(unpack(b.slice(s, 1024).column(0))).ravel(), minlength=MOST_LISTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["list", "n"])

    counts = wanted.select("vector").mapInArrow(lists_of, "list int, n long").groupBy("list").agg(F.ceil(F.sum("n") / QUERY_BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(materialise(counts, "blocks"))  # at most MOST_LISTS rows
    rows = rows.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def probes_of(queries: DataFrame, ranks: slice) -> DataFrame:
        """The lists of these ranks for queries (rep, vector, low), low the least score that matters, if one is known."""

        def run(batches):
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    c = b.slice(s, 1024)
                    q, low = unpack(c.column(1)), c.column(2).to_numpy(zero_copy_only=False).astype(float)
                    lists = index.value.probe(q)[:, ranks]
                    radius = np.fmin(index.value.radius(q, k), (q * q).sum(axis=1) + index.value.bound - 2 * low)
                    times = lists.shape[1]
                    pick = pa.array(np.repeat(np.arange(len(q)), times))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), c.column(0).take(pick), c.column(1).take(pick), pa.array(np.repeat(radius, times))], schema=_PROBE)

        probes = queries.mapInArrow(run, "list int, rep long, vector binary, radius double")
        probes = probes.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return probes.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids, found = unpack(left["vector"]), left["ids"].to_pylist(), []
        for s in range(0, right.num_rows, 256):
            part = right.slice(s, 256)
            q, reps, radius = unpack(part["vector"]), part["rep"].to_numpy(), part["radius"].to_numpy().copy()
            best = _HIT.empty_table()
            for r in range(0, len(x), SLICE):
                i, j = index.value.scan(x[r : r + SLICE], q, radius)
                if not len(i):
                    continue
                best = kept(pa.concat_tables([best, best_rows(q, reps, x, ids, i, j + r, k + 1)]), k + 1)
                index.value.tighten(q, reps, radius, best, k + 1)
            found.append(best)
        return pa.concat_tables(found) if found else _HIT.empty_table()

    def visit(probes: DataFrame) -> DataFrame:
        """Queries without rows in a list have nothing to meet there and the other way round."""
        keys = ["list", "part", "block"]
        return rows.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(meet, "rep long, score double, vec_id long")

    def sampled(batches):
        """What the sample offers each query: with it, fewer than k rows are found only where there aren't more."""
        for b in batches:
            for s in range(0, b.num_rows, 256):
                c = b.slice(s, 256)
                q, x = unpack(c.column(1)), index.value.sample
                n = min(k + 1, len(x))
                j = np.argpartition(-(q @ x.T), n - 1, axis=1)[:, :n]
                yield from best_rows(q, c.column(0).to_numpy(), x, index.value.sample_ids, np.repeat(np.arange(len(q)), n), j.ravel(), k + 1).to_batches()

    near = materialise(visit(probes_of(wanted.withColumn("low", F.lit(None).cast("double")), slice(0, 1))), "near")
    reached = near.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k + 1)
    bounded = wanted.join(reached, "rep", "left").select("rep", "vector", F.col("least").alias("low"))
    hits = near.unionByName(visit(probes_of(bounded, slice(1, None)))) if index.value.probes > 1 else near
    hits = hits.unionByName(wanted.mapInArrow(sampled, "rep long, score double, vec_id long")).withColumn("less", -F.col("score"))
    best = first_of_groups(hits, ["rep"], ["less", "vec_id"], 2 * k + 2, salts=1)  # a row may be found both ways
    best = best.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("less", "vec_id", "score"))).alias("best"))
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best, "rep")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
