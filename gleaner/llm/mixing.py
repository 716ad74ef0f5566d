"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import tables

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks that each source is cut into by a hash of the id.
BLOCKS = 1024
#: Shards of a report.
SHARDS = 16
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Words of a shard's file, about; shards at least; more of either as a mix grows.
FILE_WORDS, LEAST_SHARDS = 1 << 23, 32
#: Rows of a plan that are broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key, block) of every row; size is the number of words of the whole text."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.lit(BLOCKS)).alias("block"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds place, weight and target to sources (source, source_size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all
    words; a target stops at ``repeats`` times its source, and the excess goes to the rest
    by weight until none is above. That is one water level: sources fill up in the order
    of their cap for each unit of weight, and the level is what is left for the weights
    that are left, at the first source that it doesn't fill. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(order) - 1)
    turns = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = placed.withColumn("weight", F.element_at(turns, (F.col("place") % F.lit(len(weights)) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(repeats))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("filled")) / F.col("open")
    placed = placed.withColumn("filled", F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    placed = placed.withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    placed = placed.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    placed = placed.withColumn("level", F.first("level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return placed.select("source", "source_size", "place", "weight", target.alias("target"))


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _ln_factorial(n: Column) -> Column:
    """ln n! to about twelve digits: a table below 20, Stirling's series from there."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)])
    x = F.greatest(n, F.lit(20)).cast("double")
    large = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 20, F.element_at(small, F.greatest(n, F.lit(0)).cast("int") + 1)).otherwise(large)


def _ratio(above: list[Column], below: list[Column]) -> Column:
    """The product of the factorials above over that of those below."""
    terms = [F.struct(F.lit(sign).alias("sign"), n.alias("n")) for sign, all_n in ((1.0, above), (-1.0, below)) for n in all_n]
    return F.exp(F.aggregate(F.array(*terms), F.lit(0.0), lambda total, t: total + t["sign"] * _ln_factorial(t["n"])))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among ``marked``: the quantile at u, by inverting the distribution.

    The sum begins twelve standard deviations below the mean and ends as far above it;
    what lies outside is under 1e-30. Its length is in proportion to the root of drawn.
    """
    total, marked, drawn = total.cast("long"), marked.cast("long"), drawn.cast("long")
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * marked / n
    spread = 12 * F.sqrt(F.greatest(mean * (1 - marked / n) * (n - drawn) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) + 2
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - spread).cast("long"))
    high = F.least(marked, drawn, F.ceil(mean + spread).cast("long"))
    step = lambda k: ((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1))

    def merge(s: Column, k: Column) -> Column:
        more = _let(s["p"] * step(s["k"]), lambda p: F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["sum"] + p).alias("sum")))
        return F.when(s["sum"] >= u, s).otherwise(more)

    def walk(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        first = _ratio([marked, total - marked, drawn, total - drawn], [low, marked - low, drawn - low, total - marked - drawn + low, total])
        start = _let(first, lambda p: F.struct(low.alias("k"), p.alias("p"), p.alias("sum")))
        steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
        return F.least(F.aggregate(steps, start, merge)["k"], high)

    return _let(F.struct(low.alias("low"), high.alias("high")), walk)


def _uniform(*key) -> Column:
    """A number from 0 to 1 that its key fixes, in SQL of any kind the same."""
    digest = F.md5(F.concat_ws("/", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _draw(marked: Column, drawn: Column, total: Column, key) -> Column:
    """How many of each kind come when ``drawn`` are drawn blindly out of ``total``; marked: array of (i, q), q of kind i.

    One kind after another, each given those before it.
    """
    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("taken"))

    def one(s: Column, x: Column) -> Column:
        return _let(
            hypergeometric(s["total"], x["q"], s["drawn"], _uniform(*key, x["i"])),
            lambda k: F.struct((s["total"] - x["q"]).alias("total"), (s["drawn"] - k).alias("drawn"), F.concat(s["taken"], F.array(k)).alias("taken")),
        )

    return F.aggregate(marked, start, one)["taken"]


def _total(quotas: Column) -> Column:
    return F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)


def _numbered(quotas: Column, first: Column) -> Column:
    return F.transform(quotas, lambda q, i: F.struct((first + i).alias("i"), q.alias("q")))


def _middle(node: Column) -> Column:
    return node["low"] + F.floor((node["high"] - node["low"]) / 2).cast("int")


def _left_share(node: Column, total: Column) -> Column:
    """Draws that the left half of a node's shards get: in proportion to its shards, rounded down."""
    return F.floor(total * (_middle(node) - node["low"]) / (node["high"] - node["low"])).cast("long")


def _halves(node: Column, left: Column) -> Column:
    """Nodes (low, high, quotas) of the two halves of a node, given what goes left."""
    sides = ((node["low"], _middle(node), left), (_middle(node), node["high"], F.zip_with(node["quotas"], left, lambda a, b: a - b)))
    return F.array(*[F.struct(low.alias("low"), high.alias("high"), q.alias("quotas")) for low, high, q in sides])


#: Sources whose quotas are one row's.
SOURCES_A_ROW = 256


def split(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Splits quotas (place, n) of sources numbered from 0 among shards: (place, shard, n), n over 0.

    A node of the tree has the quotas of the shards below it and halves them: how many
    blocks of each source go left is drawn as if that many blocks were drawn blindly from
    all of the node's. So every shard gets the mix of sources that a shuffle of all blocks
    would give it, and quotas add up exactly. A row has the quotas of SOURCES_A_ROW
    sources. If there are more, a level first draws how much of each such row goes left,
    from the rows' totals alone, and then every row for itself how much of each source.
    """
    grouped = quotas.groupBy(F.floor(F.col("place") / SOURCES_A_ROW).cast("int").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("all"))
    node = F.struct(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.transform("all", lambda x: x["n"]).alias("quotas"))
    nodes = grouped.select("grp", node.alias("node"))
    levels = math.ceil(math.log2(shards)) if shards > 1 else 0
    first = (F.col("grp") * SOURCES_A_ROW).cast("long")
    if tables.few(grouped, 1):

        def halves(node: Column) -> Column:
            left = _let(_total(node["quotas"]), lambda t: _draw(_numbered(node["quotas"], first), _left_share(node, t), t, (seed, node["low"], node["high"])))
            return F.when(node["high"] - node["low"] < 2, F.array(node)).otherwise(_let(left, lambda x: _halves(node, x)))

        for_all = F.array("node")
        if levels:
            for_all = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), for_all, lambda now, _: F.flatten(F.transform(now, halves)))
        nodes = nodes.select("grp", F.explode(for_all).alias("node"))
    else:
        nodes = materialise(nodes, "nodes")
        for _ in range(levels):
            whole = nodes.withColumn("total", _total(F.col("node.quotas"))).where("total > 0")
            open_nodes = whole.where("node.high - node.low > 1").select("grp", "node", "total", F.col("node.low").alias("low"), F.col("node.high").alias("high"))
            of_node = F.array_sort(F.collect_list(F.struct(F.col("grp").alias("i"), F.col("total").alias("q"))))
            rows = open_nodes.groupBy("low", "high").agg(of_node.alias("rows"), F.sum("total").alias("all"))
            rows = rows.withColumn("taken", _draw(F.col("rows"), _left_share(F.struct("low", "high"), F.col("all")), F.col("all"), (seed, F.col("low"), F.col("high"), "row")))
            rows = rows.select("low", "high", F.explode(F.arrays_zip("rows", "taken")).alias("r")).select("low", "high", F.col("r.rows.i").alias("grp"), F.col("r.taken").alias("drawn"))
            left = _draw(_numbered(F.col("node.quotas"), first), F.col("drawn"), F.col("total"), (seed, F.col("low"), F.col("high")))
            opened = open_nodes.join(rows, ["low", "high", "grp"]).select("grp", F.explode(_halves(F.col("node"), left)).alias("node"))
            nodes = materialise(whole.where("node.high - node.low < 2").select("grp", "node").unionByName(opened), "nodes")
    found = nodes.select("grp", F.col("node.low").alias("shard"), F.posexplode("node.quotas").alias("at", "n"))
    return found.where("n > 0").select((first + F.col("at")).alias("place"), "shard", "n")


def plan(sized: DataFrame, shards: int = 16, seed: int = 0, **shares) -> DataFrame:
    """(source, block, source_size, target, draws) for each block that has rows.

    draws: array of (pass, shard, cut), one for each time that the block is drawn; with a
    cut, only rows whose key is up to it are. A source gives as many whole passes over its
    blocks as its target holds, then blocks in a permuted order up to the target, the last
    of them up to a row. The shards' shares of the draws come from split().
    """
    blocks = materialise(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    named = sources.withColumnRenamed("source", "name")
    mixed = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("block").cast("string")).cast("binary"))
    order = Window.partitionBy("source").orderBy("mix", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.join(named, F.col("source").eqNullSafe(F.col("name"))).withColumn("mix", mixed)
    placed = placed.withColumn("before", F.sum("words").over(order) - F.col("words"))
    placed = materialise(placed.drop("name", "weight"), "placed")

    # The block that the rest of a target ends in: rows by key, up to the nearest one.
    edge = placed.where("before < rest and rest < before + words").select(F.col("source").alias("of"), F.col("block").alias("at"), (F.col("rest") - F.col("before")).alias("room"))
    rows = sized.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    rows = rows.groupBy("of", "at", "room", "key").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("of", "at").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("words").over(run)).where("upto - words / 2.0 <= room")
    cuts = rows.groupBy("of", "at").agg(F.max("key").alias("cut"))
    placed = placed.join(cuts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")), "left").drop("of", "at")

    whole = F.sequence(F.lit(1).cast("long"), F.col("passes"))
    in_rest = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit("")).otherwise(F.col("cut"))
    none = F.array().cast("array<struct<pass:bigint,cut:string>>")
    draws = F.concat(
        F.when(F.col("passes") > 0, F.transform(whole, lambda p: F.struct(p.alias("pass"), F.lit("").alias("cut")))).otherwise(none),
        F.when((F.col("before") < F.col("rest")) & in_rest.isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("pass"), in_rest.alias("cut")))).otherwise(none),
    )
    drawn = placed.select("place", "block", "mix", F.explode(draws).alias("d")).select("place", "block", "mix", "d.pass", "d.cut")
    turn = Window.partitionBy("place").orderBy("pass", F.md5(F.concat_ws("/", "mix", F.col("pass").cast("string")).cast("binary")), "block")
    drawn = materialise(drawn.withColumn("turn", F.row_number().over(turn) - 1), "draws")

    # Every source's number of draws, split among shards; a shard draws the next blocks of each.
    counted = sources.select("place").join(drawn.groupBy("place").agg(F.count("*").alias("n")), "place", "left").select(F.col("place").cast("long"), F.coalesce("n", F.lit(0)).alias("n"))
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares_of = split(materialise(counted, "quotas"), shards, seed).withColumn("end", F.sum("n").over(upto))
    turns = shares_of.select("place", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("turn"))
    dealt = drawn.join(turns, ["place", "turn"]).groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "cut"))).alias("draws"))
    return placed.join(dealt, ["place", "block"], "left").select("source", "block", "source_size", "target", "draws")


def _drawn(sized: DataFrame, shards: int, seed: int, **shares) -> DataFrame:
    """sized with source_size, target, and draws (pass, shard) of each row; no row is shuffled if the plan is small."""
    made = materialise(plan(sized.select("source", "block", "size", "key"), shards, seed, **shares), "plan")
    made = made.select(F.col("source").alias("of"), F.col("block").alias("at"), "source_size", "target", "draws")
    if made.count() <= BROADCAST_ROWS:
        made = F.broadcast(made)
    found = sized.join(made, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    mine = F.filter("draws", lambda d: (d["cut"] == "") | (F.col("key") <= d["cut"]))
    return found.withColumn("draws", F.coalesce(mine, F.array().cast("array<struct<pass:bigint,shard:int,cut:string>>")))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """What a mix takes of every row: (doc_id, size, source_size, target, taken, shards).

    shards are the shards that the splitting tree deals the row to, in order, comma-joined,
    one for each time that it is drawn, and taken is its size as often. Only whole rows are
    taken, at most ``repeats`` times each, up to the row whose end is nearest to the
    source's target. Null and empty texts have size 0; a null source is one more source,
    the last; rows of one id (repeated, or null ids) are taken alike; an empty table gives
    no rows; other columns are not read. Reruns agree, as ids alone decide.
    """
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
    dealt = F.array_sort(F.transform("draws", lambda d: d["shard"]))
    return _drawn(sized, shards, seed, **shares).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join(F.transform(dealt, lambda i: i.cast("string")), ",").alias("shards")
    )


def mix(docs: DataFrame, shards: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mix itself: rows of docs, as often as they are taken, dealt by shard and shuffled within; columns unchanged.

    Null and empty texts are rows of no words, taken with the block that they are in;
    repeated rows, and rows of one id or of none, are taken alike; an empty table gives an
    empty one. A partition is one file of a shard, so that writing it writes them. Shards are
    even by construction: no source, however large, fills one. Without a number of shards,
    there are as many as the words ask for, up to one for each block of a source; beyond,
    a shard has several files, among which its rows are dealt by a hash.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    plain = {c: F.col("row").getField(c) for c in {id_col, text_col, source_col}}
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
    words = shares.get("share", SHARE) * (sized.agg(F.sum("size")).first()[0] or 0)
    shards = shards or min(BLOCKS, max(LEAST_SHARDS, math.ceil(words / FILE_WORDS)))
    files = max(1, math.ceil(words / FILE_WORDS / shards))
    keyed = inner.select("row", *[plain[c].alias(c) for c in plain]).select("row", *_keys(id_col, source_col))
    made = materialise(plan(sized.select("source", "block", "size", "key"), shards, seed, **shares), "plan").where("draws is not null")
    made = made.select(F.col("source").alias("of"), F.col("block").alias("at"), "draws")
    if made.count() <= BROADCAST_ROWS:
        made = F.broadcast(made)
    found = keyed.join(made, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    found = found.select("row", "key", F.explode(F.filter("draws", lambda d: (d["cut"] == "") | (F.col("key") <= d["cut"]))).alias("d"))
    mixed = F.xxhash64(F.lit(seed), "key", F.col("d.pass"))
    file = F.col("d.shard") * files + F.pmod(F.xxhash64(F.lit("file"), mixed), F.lit(files)).cast("int")
    dealt = found.withColumn("file", file).repartitionById(shards * files, F.col("file"))
    return dealt.sortWithinPartitions("file", mixed, F.col("d.pass")).select(*[F.col("row").getField(c).alias(c) for c in columns])


def _keys(id_col: str, source_col: str) -> list[Column]:
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return [F.col(source_col).cast("string").alias("source"), key.alias("key"), (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.lit(BLOCKS)).alias("block")]


_PMF = "exp(" + " ".join(f"{sign} lgamma({n} + 1)" for sign, n in zip("++++-----", ("m", "(total - m)", "drawn", "(total - drawn)", "k", "(m - k)", "(drawn - k)", "(total - m - drawn + k)", "total"), strict=True)) + ")"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
k AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % {BLOCKS} AS block FROM d),
b AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words, md5('0/' || coalesce(source, '') || '/' || block) AS mix FROM k GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM b GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS everything,
  sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) - cap AS filled,
  sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s2),
s4 AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(everything AS DOUBLE) - CAST(filled AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM s3),
l AS (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
s AS (SELECT source, place, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(cap AS DOUBLE))) AS target FROM s4),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM s),
o AS (SELECT b.*, place, source_size, target, passes, target - passes * source_size AS rest,
  sum(words) OVER (PARTITION BY b.source ORDER BY mix, block ROWS UNBOUNDED PRECEDING) - words AS before
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
e AS (SELECT k.source, k.block, k.key, rest - before AS room, sum(size) AS words FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.block = o.block
  WHERE before < rest AND rest < before + words GROUP BY ALL),
r AS (SELECT *, sum(words) OVER (PARTITION BY source, block ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto FROM e),
c AS (SELECT source, block, max(key) AS cut FROM r WHERE upto - words / 2.0 <= room GROUP BY ALL),
w AS (SELECT o.*, cut, before < rest AND (before + words <= rest OR cut IS NOT NULL) AS more FROM o LEFT JOIN c ON o.source IS NOT DISTINCT FROM c.source AND o.block = c.block),
x AS (SELECT place, block, mix, pass, '' AS cut FROM w, unnest(range(1, passes + 1)) AS t(pass) UNION ALL SELECT place, block, mix, 0, CASE WHEN before + words <= rest THEN '' ELSE cut END FROM w WHERE more),
y AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY pass, md5(mix || '/' || pass), block) - 1 AS turn FROM x),
z AS (SELECT list(n ORDER BY place) AS q FROM (SELECT p.place, count(y.turn) AS n FROM p LEFT JOIN y ON y.place = p.place GROUP BY 1)),
tree AS (
  SELECT 0 AS low, {SHARDS} AS high, q, 1 AS i, CAST(list_sum(q) AS BIGINT) AS total, CAST(floor(list_sum(q) * ({SHARDS} // 2) / CAST({SHARDS} AS DOUBLE)) AS BIGINT) AS drawn, CAST([] AS BIGINT[]) AS lefts FROM z
  UNION ALL
  (WITH now AS (SELECT * FROM tree WHERE high - low > 1),
   going AS (SELECT *, q[i] AS m, CAST('0x' || substr(md5('0/' || low || '/' || high || '/' || (i - 1)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM now WHERE i <= len(q)),
   steps AS (SELECT low, high, k, sum({_PMF}) OVER (PARTITION BY low, high ORDER BY k) AS upto FROM going, unnest(range(greatest(0, drawn + m - total), least(m, drawn) + 1)) AS t(k)),
   picked AS (SELECT g.low, g.high, min(k) AS k FROM going AS g JOIN steps AS s ON s.low = g.low AND s.high = g.high WHERE upto >= u GROUP BY 1, 2),
   went AS (SELECT g.*, coalesce(picked.k, least(m, drawn)) AS k FROM going AS g LEFT JOIN picked ON picked.low = g.low AND picked.high = g.high),
   halves AS (SELECT CASE WHEN side = 0 THEN low ELSE low + (high - low) // 2 END AS low, CASE WHEN side = 0 THEN low + (high - low) // 2 ELSE high END AS high,
     CASE WHEN side = 0 THEN lefts ELSE list_transform(range(1, len(q) + 1), lambda j: q[j] - lefts[j]) END AS q FROM now, unnest([0, 1]) AS t(side) WHERE i > len(q))
   SELECT low, high, q, i + 1, CAST(total - m AS BIGINT), CAST(drawn - k AS BIGINT), list_append(lefts, k) FROM went
   UNION ALL SELECT low, high, q, 1, CAST(list_sum(q) AS BIGINT), CAST(floor(list_sum(q) * ((high - low) // 2) / CAST(high - low AS DOUBLE)) AS BIGINT), [] FROM halves)),
h AS (SELECT low AS shard, j - 1 AS place, q[j] AS n FROM tree, unnest(range(1, len(q) + 1)) AS t(j) WHERE high - low = 1 AND i = 1),
g AS (SELECT place, shard, sum(n) OVER (PARTITION BY place ORDER BY shard) AS upto, n FROM h),
f AS (SELECT y.place, y.block, y.cut, g.shard FROM y JOIN g ON g.place = y.place AND y.turn >= g.upto - g.n AND y.turn < g.upto),
v AS (SELECT place, block, list(struct_pack(shard := shard, cut := cut)) AS draws FROM f GROUP BY ALL),
r2 AS (SELECT k.doc_id, k.size, o.source_size, o.target, list_sort(list_transform(list_filter(coalesce(draws, []), lambda x: x.cut = '' OR k.key <= x.cut), lambda x: x.shard)) AS shards
  FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.block = o.block LEFT JOIN v ON v.place = o.place AND v.block = o.block)
SELECT doc_id, size, source_size, target, CAST(size * len(shards) AS BIGINT) AS taken, array_to_string(list_transform(shards, lambda x: CAST(x AS VARCHAR)), ',') AS shards FROM r2
"""
