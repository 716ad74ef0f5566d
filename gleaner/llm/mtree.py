"""Exact top-k by integer inner product: best-first search of an M-tree in pages.

Largest inner product is least Euclidean distance once vectors get one more component,
sqrt(bound - |x|^2), and queries a zero there. The tree's nodes keep a routing object, a
covering radius and the distance to their parent's routing object, so that the triangle
inequality rules subtrees and entries out before any distance to them is computed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, first_of_groups, materialise, unpack, vectors

#: Rows that the top level and first bounds are fitted on, at most; every row is in the tree.
SAMPLE = 8192
#: Routing objects of the top level, at most, and distinct rows for each.
MOST_ROUTERS, ROUTER_ROWS = 1024, 2048
#: Rows of the tree that a task builds or searches, and queries that it searches for.
PART_ROWS, QUERY_BLOCK = 32_768, 8192
#: Entries of a leaf page, and children of an inner one.
PAGE, FANOUT = 256, 16
#: Squared length of integer vectors, at most, so that products fit a long.
MOST_SQUARE = float(1 << 62)


def lift(x: np.ndarray, bound: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(bound - (x * x).sum(axis=1), 0))])


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of a by rows of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integers held as doubles; as doubles they are exact while every |x||q| is below 2 ** 53."""
    return (x @ q).astype(np.int64) if exact else x.astype(np.int64) @ q.astype(np.int64)


_NODE = pa.schema([
    ("router", pa.int32()), ("part", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("pivot", pa.binary()), ("radius", pa.float64()), ("to_parent", pa.float64()),
    ("members", pa.binary()), ("to_pivot", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))),
])
NODE = "router int, part int, node int, parent int, pivot binary, radius double, to_parent double, members binary, to_pivot binary, ids array<array<bigint>>"


def build(router: int, part: int, x: np.ndarray, ids: list[list[int]], top: np.ndarray, bound: float, seed: int = 5) -> pa.Table:
    """The subtree of one part in pages, root first: inner nodes have no members, leaves no children.

    Rows are dealt to the nearest of FANOUT of them until a page holds them all; rows that
    can't be told apart by that are dealt evenly.
    """
    rng, y = np.random.default_rng(seed), lift(x, bound)
    columns: list[list] = [[] for _ in _NODE]
    todo = [(np.arange(len(x)), top, -1, top)]
    while todo:
        rows, pivot, parent, above = todo.pop()
        node, away = len(columns[0]), gaps(y[rows], pivot[None])[:, 0]
        leaf = len(rows) <= PAGE
        order = np.argsort(away, kind="stable") if leaf else None
        values = (
            router, part, node, parent, pivot.tobytes(), float(away.max()), float(np.sqrt(((pivot - above) ** 2).sum())),
            x[rows[order]].tobytes() if leaf else None, away[order].tobytes() if leaf else None, [ids[i] for i in rows[order]] if leaf else None,
        )
        for column, value in zip(columns, values, strict=True):
            column.append(value)
        if leaf:
            continue
        picked = rng.choice(rows, min(FANOUT, -(-len(rows) // PAGE)), replace=False)
        near = gaps(y[rows], y[picked]).argmin(axis=1)
        if np.bincount(near, minlength=len(picked)).max() > 0.9 * len(rows):
            near = np.arange(len(rows)) % len(picked)
        todo += [(rows[near == c], y[picked[c]], node, pivot) for c in range(len(picked)) if (near == c).any()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


class Subtree:
    """A part's pages, ready to be searched."""

    def __init__(self, pages: pa.Table, bound: float, exact: bool):
        self.bound, self.exact, self.slack = bound, exact, 1e-6 * max(1.0, bound**0.5)
        pages = pages.sort_by("node")
        self.pivot, self.radius, self.to_parent = unpack(pages["pivot"]), pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
        parent, d = pages["parent"].to_numpy(), self.pivot.shape[1] - 1
        by = np.argsort(parent, kind="stable")
        self.children = {int(parent[c[0]]): c for c in np.split(by, np.flatnonzero(np.diff(parent[by])) + 1)}
        held = [(m, t, i) for m, t, i in zip(pages["members"].to_pylist(), pages["to_pivot"].to_pylist(), pages["ids"].to_pylist(), strict=True)]
        self.leaf = [None if m is None else (np.frombuffer(m).reshape(-1, d), np.frombuffer(t)) for m, t, _ in held]
        sizes = [0 if m is None else len(i) for m, _, i in held]
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ids = [i for m, _, own in held if m is not None for i in own]
        self.computed = 0

    def search(self, q: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) of the k best for q, and maybe more, of those with a score of ``least`` or more."""
        lifted, norm = np.append(q, 0.0), float(q @ q)
        reach = lambda s: np.inf if s is None else np.sqrt(max(norm + self.bound - 2.0 * float(s), 0.0)) + self.slack
        best, at, r = np.zeros(0, np.int64), np.zeros(0, np.int64), reach(least)
        away = float(np.sqrt(((lifted - self.pivot[0]) ** 2).sum()))
        heap = [(max(0.0, away - self.radius[0]), 0, away)]
        while heap and heap[0][0] <= r:
            _, node, away = heapq.heappop(heap)
            leaf = self.leaf[node]
            if leaf is None:
                kids = self.children[node]
                kids = kids[np.abs(away - self.to_parent[kids]) - self.radius[kids] <= r]
                self.computed += len(kids)
                d = np.sqrt(((self.pivot[kids] - lifted) ** 2).sum(axis=1))
                low = np.maximum(d - self.radius[kids], 0)
                for i in np.flatnonzero(low <= r):
                    heapq.heappush(heap, (float(low[i]), int(kids[i]), float(d[i])))
                continue
            x, to_pivot = leaf  # entries are in the order of their distance to the pivot
            low, high = np.searchsorted(to_pivot, (away - r, away + r))
            high = min(len(to_pivot), high + 1)
            self.computed += high - low
            score = products(x[low:high], q, self.exact)
            on = np.arange(low, high) if least is None else np.flatnonzero(score >= least) + low
            best, at = np.concatenate([best, score[on - low]]), np.concatenate([at, on + self.base[node]])
            if len(best) >= k:
                cut = int(np.partition(best, len(best) - k)[len(best) - k])
                least = cut if least is None else max(least, cut)
                kept = best >= least
                best, at, r = best[kept], at[kept], reach(least)
        return at, best


def narrow(x: np.ndarray) -> bytes:
    """Rows of integers in as few bytes as hold the largest, and before them a letter for how many."""
    most = np.abs(x).max(initial=0)
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + x.astype(f"<{ {'h': 'i2', 'i': 'i4', 'd': 'f8'}[kind] }").tobytes()


def widen(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<{ {'h': 'i2', 'i': 'i4', 'd': 'f8'}[data[:1].decode()] }", offset=1).reshape(rows, -1).astype(np.float64)


_ASK = pa.schema([("router", pa.int32()), ("block", pa.int32()), ("seen", pa.bool_()), ("reps", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("vectors", pa.binary())])
ASK = "router int, block int, seen boolean, reps array<bigint>, least array<bigint>, vectors binary"


def asked_together(rep: np.ndarray, block: np.ndarray, least: list[int | None], q: np.ndarray, i: np.ndarray, router: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    """Queries i that go to each router, a row for all that go there together; seen: those that were in its first part before."""
    key = np.stack([router, block[i], seen.astype(np.int64)])
    order = np.lexsort(key)
    cuts = np.flatnonzero((np.diff(key[:, order]) != 0).any(axis=0)) + 1
    groups = np.split(order, cuts) if len(order) else []
    columns = [[int(k[g[0]]) for g in groups] for k in key[:2]] + [[bool(key[2, g[0]]) for g in groups]]
    of = [i[g] for g in groups]
    return batch(_ASK, *columns, [rep[m].tolist() for m in of], [[least[x] for x in m] for m in of], [narrow(q[m]) for m in of])


_HIT = pa.schema([("rep", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def best_ids(rep: int, ids: list[list[int]], scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k first (rep, score, id), by score and then by id, of vectors that stand for several ids each."""
    found = [(-s, i) for own, s in zip(ids, scores.tolist(), strict=True) for i in own]
    return [(rep, -s, i) for s, i in heapq.nsmallest(k, found)]


@dataclass
class Top:
    """The tree's top level, and a sample that gives every query its first bound."""

    bound: float
    exact: bool
    routers: np.ndarray
    sample: np.ndarray

    def first_bound(self, q: np.ndarray, k: int) -> np.ndarray | None:
        """A score that k vectors, the query's own maybe among them, are sure to reach."""
        if len(self.sample) < k:
            return None
        return np.array([np.partition(s, len(s) - k)[len(s) - k] for s in (products(self.sample, v, self.exact) for v in q)], np.int64)


def search(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query: (query_id, rank, vec_id, score), exactly.

    Components x become floor(scale * x). Queries are the rows whose id is divisible by
    ``every``, candidates all rows but a query's own; ranks from 1, ties to smaller ids;
    fewer candidates give fewer rows. Vectors null or holding null or non-finite components
    take no part, nor do null ids, or vectors so long (2 ** 31 or more, as integers) that
    products don't fit a long. Zero vectors take part, and a vector shorter than the
    longest one has zeros behind it. Several rows of one id are one if their vectors are equal. An empty table gives no rows; other
    columns are not read.

    Equal vectors are one entry, with their k + 1 least ids. Each task builds or searches
    one part of at most about PART_ROWS entries for at most about QUERY_BLOCK queries. A
    query first visits the part nearest to it, and what it finds there bounds the second
    visit, to all parts that its bound doesn't rule out. Queries that go the same way go
    together, as one row of as few bytes as their integers take.
    """
    spark, keep = embeddings.sparkSession, k + 1
    base = vectors(embeddings, id_col, vector_col, zero=True)

    def whole(batches):
        for b in batches:
            x = np.floor(scale * unpack(b.column(1))) + 0.0
            square = (x * x).sum(axis=1)
            fits = square < MOST_SQUARE
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fits)), pa.array([v.tobytes() for v in x[fits]], pa.binary()), pa.array(square[fits], pa.float64())], names=["vec_id", "vector", "square"])

    base = materialise(base.mapInArrow(whole, "vec_id long, vector binary, square double").distinct(), "integers")
    few = first_of_groups(base, ["vector"], ["vec_id"], keep)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids")
    distinct = materialise(distinct, "entries")
    n, bound = distinct.count(), base.agg(F.max("square")).first()[0]
    if not n:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    picked = distinct.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    sample = np.array([np.frombuffer(r["vector"]) for r in picked])
    routers = max(1, min(MOST_ROUTERS, len(sample), n // ROUTER_ROWS))
    top = spark.sparkContext.broadcast(Top(bound, bound < 2.0**53, lift(sample[:routers], bound), sample))

    def route(batches):
        for b in batches:
            at = gaps(lift(unpack(b.column(1)), top.value.bound), top.value.routers).argmin(axis=1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["router", "rep", "vector", "ids"])

    routed = materialise(distinct.mapInArrow(route, "router int, rep long, vector binary, ids array<bigint>"), "routed")
    parts = routed.groupBy("router").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts = materialise(parts, "parts")  # at most MOST_ROUTERS rows
    many = dict(parts.collect())
    several, parts = spark.sparkContext.broadcast(np.array([many.get(i, 0) for i in range(routers)])), F.broadcast(parts)

    def built(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        router, part = key[0].as_py(), key[1].as_py()
        group = group.sort_by("rep")
        return build(router, part, unpack(group["vector"]), group["ids"].to_pylist(), top.value.routers[router], top.value.bound)

    dealt = routed.join(parts, "router").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    tree = materialise(dealt.groupBy("router", "part").applyInArrow(built, NODE), "tree")
    radii = dict(tree.where("parent < 0").groupBy("router").agg(F.max("radius")).collect())  # at most MOST_ROUTERS rows
    covers = spark.sparkContext.broadcast(np.array([radii.get(i, -np.inf) for i in range(routers)]))

    asked = base.where(F.col("vec_id") % every == 0).join(distinct.select("vector", "rep"), "vector").select("vec_id", "rep")
    asked = materialise(asked, "asked")
    wanted = materialise(distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector"), "wanted")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")

    def first(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                c = b.slice(s, 1024)
                q = unpack(c.column(1))
                home, least = gaps(np.column_stack([q, np.zeros(len(q))]), top.value.routers), top.value.first_bound(q, keep)
                home = np.where(np.isneginf(covers.value), np.inf, home).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(least if least is not None else [None] * len(q), pa.int64()), pa.array(home, pa.int32())], names=["rep", "vector", "block", "least", "home"])

    first_asks = wanted.withColumn("block", block).mapInArrow(first, "rep long, vector binary, block int, least long, home int")
    first_asks = materialise(first_asks, "asks")

    def together(batches, of):
        """Asks of batches of (rep, vector, block, least, home); of: which queries go to which routers, and whether they have been there."""
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                c = b.slice(s, 1024)
                q, least, home = unpack(c.column(1)), c.column(3).to_pylist(), c.column(4).to_numpy()
                i, router = of(q, least, home)
                yield asked_together(c.column(0).to_numpy(), c.column(2).to_numpy(), least, q, i, router, router == home[i])

    def meet(pages: pa.Table, queries: pa.Table) -> pa.Table:
        hits = []
        if pages.num_rows and queries.num_rows:
            subtree = Subtree(pages, top.value.bound, top.value.exact)
            for reps, bounds, vectors in zip(queries["reps"].to_pylist(), queries["least"].to_pylist(), queries["vectors"].to_pylist(), strict=True):
                for rep, least, q in zip(reps, bounds, widen(vectors, len(reps)), strict=True):
                    at, scores = subtree.search(q, least, keep)
                    hits += best_ids(rep, [subtree.ids[i] for i in at], scores, keep)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([], [], []))], schema=_HIT)

    def visit(asks: DataFrame) -> DataFrame:
        """asks (as _ASK, and part): pages go to the blocks that ask for them."""
        places = asks.select(F.col("router").alias("r"), F.col("part").alias("p"), F.col("block").alias("to")).distinct()
        left = tree.join(places, (F.col("router") == F.col("r")) & (F.col("part") == F.col("p"))).drop("r", "p").groupBy("router", "part", "to")
        return left.cogroup(asks.groupBy("router", "part", "block")).applyInArrow(meet, "rep long, score long, vec_id long")

    def go_home(batches):
        yield from together(batches, lambda q, least, home: (np.arange(len(q)), home))

    home = first_asks.mapInArrow(go_home, ASK).withColumn("part", F.lit(0))
    hits = materialise(visit(home), "home")
    reached = hits.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounds = first_asks.join(reached, "rep", "left").withColumn("least", F.greatest("least", F.when(F.col("n") >= keep, F.col("low"))))

    def not_ruled_out(q, least, home):
        bound = np.array([np.nan if x is None else x for x in least], float)
        reach = np.sqrt(np.maximum((q * q).sum(axis=1) + top.value.bound - 2 * bound, 0)) + 1e-6 * max(1.0, top.value.bound**0.5)
        low = gaps(np.column_stack([q, np.zeros(len(q))]), top.value.routers) - covers.value
        i, j = np.nonzero(~(low > reach[:, None]) & np.isfinite(covers.value))
        on = (j != home[i]) | (several.value[j] > 1)
        return i[on], j[on]

    def rest(batches):
        yield from together(batches, not_ruled_out)

    more = bounds.select("rep", "vector", "block", "least", "home").mapInArrow(rest, ASK).join(parts, "router")
    more = more.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("not seen or part > 0").drop("parts")
    hits = hits.unionByName(visit(materialise(more, "asks"))).withColumn("less", -F.col("score"))
    best = first_of_groups(hits, ["rep"], ["less", "vec_id"], keep)
    best = best.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("less", "vec_id", "score"))).alias("best"))
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best, "rep")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")


def oracle(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    """DuckDB SQL of search() over embeddings of one length, none of them null."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
