"""Queries of relational operators over the driver's tables, each beside its DuckDB SQL.

The tables have no labelled corpora. So columns that operators need are made of what there
is by rules that both engines share, and whole tables go through the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as texts
from gleaner.functions import urls
from gleaner.operators import corpus, dedup, generate, joins, leakage, metrics, policy, rules, splits
from gleaner.plans.registry import query, table

# Exact duplicates, places, conflicts.


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR text IS NULL")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return dedup.keep_first(table(spark, sf_dir, "documents"), F.col("text"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS variants FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def conflicting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one source has."""
    return dedup.conflicting(table(spark, sf_dir, "documents").where("text is not null"), F.col("text"), F.col("source"))


@query(
    """WITH p AS (SELECT o_orderkey, o_orderstatus AS country, o_orderpriority AS city, o_orderkey % 5 = 0 AS street FROM orders)
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY country, city, street ORDER BY o_orderkey) AS r FROM p) WHERE street OR r = 1"""
)
def same_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as places: priorities as towns, a fifth of them with a house number."""
    rows = table(spark, sf_dir, "orders")
    town = F.struct(F.lit("city").alias("label"), F.lit(0).alias("start"), F.octet_length("o_orderpriority").alias("end"))
    house = F.struct(F.lit("house_number").alias("label"), (town["end"] + 1).alias("start"), (town["end"] + 2).alias("end"))
    spans = F.when(F.col("o_orderkey") % 5 == 0, F.array(town, house)).otherwise(F.array(town))
    made = rows.select("o_orderkey", F.col("o_orderstatus").alias("country"), F.concat("o_orderpriority", F.lit(" 7, "), F.col("o_orderkey").cast("string")).alias("text"), spans.alias("spans"))
    return dedup.same_place(made, ["o_orderkey"]).select("o_orderkey")


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_custkey % 400 AS k, o_orderkey % 7 = 0 AS augmented, CASE WHEN o_orderkey % 11 = 0 THEN 'valid' WHEN o_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split,
  o_orderkey - 1 AS original, o_orderpriority AS text, o_orderstatus AS country FROM orders)
SELECT (SELECT count(*) FROM (SELECT k FROM r WHERE NOT augmented GROUP BY k HAVING count(DISTINCT split) > 1)) AS keys_in_two_splits,
  (SELECT count(*) FROM r WHERE augmented AND split <> 'train') AS copies_outside_train,
  (SELECT count(*) FROM r AS c LEFT JOIN r AS o ON o.id = c.original AND NOT o.augmented WHERE c.augmented AND (o.id IS NULL OR o.split <> 'train' OR o.country <> c.country)) AS orphan_copies,
  (SELECT count(*) FROM (SELECT country, text FROM r WHERE NOT augmented GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)) AS components_in_two_splits"""
)
def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a corpus must not have, counted over orders as examples: every seventh is a copy of the one before."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    span = F.array(F.struct(F.lit("road").alias("label"), F.lit(0).alias("start"), F.octet_length("o_orderpriority").alias("end")))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), (c % 400).cast("string").alias("group_key"), (k % 7 == 0).alias("augmented"), F.when(k % 11 == 0, "valid").when(c % 10 == 0, "test").otherwise("train").alias("split"),
        (k - 1).alias("original"), F.col("o_orderpriority").alias("text"), span.alias("spans"), F.col("o_orderstatus").alias("country"),
    )
    return corpus.checks(rows)


# Scores.

_MEMBERS_SQL = """m AS (SELECT l_orderkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'address' END AS kind, l_partkey AS start, l_partkey + l_linenumber AS "end",
  CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 4 END AS owner, l_suppkey, l_discount FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem)),
g AS (SELECT doc, kind, start, "end", max(owner) AS owner, max(l_suppkey) AS s FROM m GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT doc, kind, start, "end", CASE WHEN s % 7 = 0 THEN (owner + 1) % 4 WHEN s % 9 = 0 THEN NULL ELSE owner END AS owner FROM g WHERE s % 11 > 0),
j AS (SELECT g.kind, g.owner AS g, p.owner AS p FROM g LEFT JOIN p ON p.doc = g.doc AND p.kind = g.kind AND p.start = g.start AND p."end" = g."end"),
k AS (SELECT *, g IS NOT DISTINCT FROM p AS ok, g IS NOT NULL AND p IS NULL AS gone FROM j)"""
_OWNED = """CAST(sum(CAST(ok AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(NOT ok AND NOT gone AS INT)) AS BIGINT) AS wrong, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS missed,
coalesce(round(CAST(sum(CAST(ok AS INT)) AS DOUBLE) / nullif(sum(CAST(ok AS INT)) + sum(CAST(NOT ok AND NOT gone AS INT)) + sum(CAST(gone AS INT)), 0), 4), 0) AS accuracy"""


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as details of contacts, and the same as a grouper might have them."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount").distinct()
    kind = F.when(F.col("l_linenumber") % 3 == 0, "email").when(F.col("l_linenumber") % 3 == 1, "phone").otherwise("address")
    made = items.select(
        F.col("l_orderkey").alias("doc"), kind.alias("kind"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end"),
        F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 4).alias("owner"), "l_suppkey",
    )
    gold = made.groupBy("doc", "kind", "start", "end").agg(F.max("owner").alias("owner"), F.max("l_suppkey").alias("s"), F.count("*").alias("n")).where("n = 1").drop("n")
    owner = F.when(F.col("s") % 7 == 0, (F.col("owner") + 1) % 4).when(F.col("s") % 9 == 0, None).otherwise(F.col("owner"))
    return gold.drop("s"), gold.where("s % 11 > 0").withColumn("owner", owner).drop("s")


@query(f"WITH {_MEMBERS_SQL} SELECT {_OWNED} FROM k")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose details are taken to be whose, over all."""
    return metrics.assignments(*_members(spark, sf_dir), "doc")


@query(f"WITH {_MEMBERS_SQL} SELECT kind, {_OWNED} FROM k GROUP BY kind")
def field_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose details are taken to be whose, by kind."""
    return metrics.field_ownership(*_members(spark, sf_dir), "doc")


@query(
    """WITH g AS (SELECT o_custkey AS doc, list_sort(list(DISTINCT o_orderstatus)) AS members FROM orders GROUP BY 1),
p AS (SELECT o_custkey AS doc, list_sort(list(DISTINCT o_orderstatus)) AS members, (o_custkey % 10) / CAST(10 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 13 > 0 GROUP BY 1),
j AS (SELECT p.*, g.doc IS NOT NULL AS matched FROM p LEFT JOIN g ON g.doc = p.doc AND g.members = p.members)
SELECT (SELECT count(*) FROM g) AS gold, count(*) AS predicted, CAST(sum(CAST(matched AS INT)) AS BIGINT) AS exact, CAST(sum(CAST(confidence >= 0.9 AS INT)) AS BIGINT) AS high,
  CAST(sum(CAST(confidence >= 0.9 AND matched AS INT)) AS BIGINT) AS high_exact FROM j"""
)
def exact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards of the statuses of their orders, against cards with some orders left out."""
    orders = table(spark, sf_dir, "orders")
    cards = lambda rows: rows.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("members"))
    predicted = cards(orders.where("o_orderkey % 13 > 0")).withColumn("confidence", (F.col("doc") % 10) / F.lit(10.0))
    return metrics.exact_cards(cards(orders), predicted, "doc")


@query(
    """WITH w AS (SELECT p_partkey, p_brand AS country, string_split(p_name, ' ')[1] AS a, p_name FROM part WHERE contains(p_name, ' ')),
s AS (SELECT country, length(replace(p_name, ' ', '')) AS n, CASE p_partkey % 4 WHEN 0 THEN length(a) ELSE length(replace(p_name, ' ', '')) END AS ok, CAST(p_partkey % 4 <> 0 AS INT) AS e FROM w),
c AS (SELECT country, count(*) AS rows, CAST(sum(e) AS BIGINT) AS exact, CAST(sum(n) AS BIGINT) AS characters, CAST(sum(ok) AS BIGINT) AS correct FROM s GROUP BY GROUPING SETS ((country), ()))
SELECT *, round(exact / CAST(rows AS DOUBLE), 4) AS exact_rate, round(correct / CAST(characters AS DOUBLE), 4) AS accuracy FROM c"""
)
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as parsed addresses, of which a quarter miss all but the first component."""
    rows = table(spark, sf_dir, "part").where(F.col("p_name").contains(" "))
    cut, end = F.instr("p_name", " ") - 1, F.length("p_name")
    span = lambda label, s, e: F.struct(F.lit(label).alias("label"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    first, second = span("road", F.lit(0), cut), span("city", cut + 1, end)
    made = rows.select(F.col("p_brand").alias("country"), F.col("p_name").alias("text"), F.array(first, second).alias("gold"), F.when(F.col("p_partkey") % 4 == 0, F.array(first)).otherwise(F.array(second, first)).alias("predicted"))
    return metrics.parse_scores(made)


@query(
    """WITH v AS (SELECT l_linestatus AS kind, CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_returnflag = 'A' AND l_partkey % 3 = 0 THEN 'wrong_boundary' WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'wrong' ELSE 'correct' END AS v FROM lineitem),
c AS (SELECT kind, CAST(sum(CAST(v = 'correct' AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(v = 'wrong_boundary' AS INT)) AS BIGINT) AS wrong_boundary, CAST(sum(CAST(v = 'missing' AS INT)) AS BIGINT) AS missing, CAST(sum(CAST(v = 'wrong' AS INT)) AS BIGINT) AS wrong FROM v GROUP BY 1),
s AS (SELECT *, round(correct / CAST(correct + wrong_boundary + wrong AS DOUBLE), 4) AS precision, round(correct / CAST(correct + missing + wrong_boundary AS DOUBLE), 4) AS recall FROM c)
SELECT *, precision >= 0.85 AND recall >= 0.80 AS accept FROM s"""
)
def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviewed spans."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    verdict = F.when(F.col("l_linenumber") == 1, "missing").when((flag == "A") & (part % 3 == 0), "wrong_boundary").when((flag == "R") & (part % 5 == 0), "wrong").otherwise("correct")
    return metrics.review_score(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), verdict.alias("verdict")))


@query("SELECT l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each reason has."""
    return metrics.drop_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("reason")))


@query("SELECT event_type AS kind, bool_and(value >= 0.5) AS passed FROM events WHERE event_id >= 100 GROUP BY 1")
def learning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events that never fall below a value after the start."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("kind"), "value")
    return metrics.learning_gate(rows, "step", "kind", "value", 100, 0.5)


@query(
    """SELECT l_orderkey AS "case", l_returnflag AS kind, l_linestatus AS text FROM lineitem AS l
WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_orderkey = l.l_orderkey AND l.l_returnflag = 'R' AND o.o_orderstatus = l.l_linestatus)"""
)
def forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items whose status is that of their order."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("text"))
    must_not = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.lit("R").alias("kind"), F.col("o_orderstatus").alias("text"))
    return metrics.forbidden(items, must_not, "case")


@query("SELECT doc_id, n_chars % 97 AS wrong, (doc_id % 13) / CAST(13 AS DOUBLE) AS confidence FROM documents ORDER BY wrong DESC, confidence, doc_id LIMIT 50")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the fifty documents with most wrong characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("wrong"), (F.col("doc_id") % 13 / F.lit(13.0)).alias("confidence"))
    return metrics.worst(rows, "wrong", "confidence", "doc_id", 50)


# Splits, quotas, views.


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) < 12")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and sources with fewer documents than a quota."""
    return splits.uncovered(table(spark, sf_dir, "documents"), ["lang", "source"], 12)


_MIX = "md5('0:' || {})"


@query(
    f"""WITH m AS (SELECT doc_id, source, {_MIX.format("doc_id")} AS mix FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id) AS r FROM m),
n AS (SELECT count(DISTINCT source) AS n FROM documents) SELECT doc_id, source FROM r, n WHERE r <= 120 ORDER BY CASE WHEN r <= 120 // n THEN 0 ELSE 1 END, mix, doc_id LIMIT 120"""
)
def equal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 120 documents, as many of each source as there are."""
    return splits.equal_shares(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 120)


@query(f"""SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {_MIX.format("concat_ws(':', lang, doc_id)")}, doc_id) AS INTEGER) AS round FROM documents""")
def mixed_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round in which each document's language has its turn."""
    return splits.mixed_passes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", F.col("turn.round").alias("round"))


@query(
    """WITH v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS view_no, turn AS view FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, count(*) AS n FROM v GROUP BY 1)
SELECT c.conv_id, c.turn, v.view FROM conversations AS c LEFT JOIN n ON n.conv_id = c.conv_id LEFT JOIN v ON v.conv_id = c.conv_id AND c.turn % 2 = 1 AND v.view_no = (c.turn // 2) % n.n"""
)
def rotating_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as presentations: odd ones show the user's turns in rotation."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations")
    numbered = rows.where("role = 'user'").withColumn("view_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return splits.rotating_views(rows.select("conv_id", "turn"), numbered.select("conv_id", "view_no", F.col("turn").alias("view")), "conv_id", "turn").select("conv_id", "turn", "view")


# Leakage.


@query(
    """WITH c AS (SELECT DISTINCT c_custkey AS id, CAST(floor(c_acctbal / 20) AS BIGINT) AS k FROM customer), s AS (SELECT DISTINCT s_suppkey AS id, CAST(floor(s_acctbal / 20) AS BIGINT) AS k FROM supplier)
SELECT c.id, c.k, string_agg(s.id, ',' ORDER BY s.id) AS others FROM c JOIN s ON s.k = c.k GROUP BY 1, 2"""
)
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the suppliers of about their balance, as keys of two corpora that meet."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 20).alias("k"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") / 20).alias("k"))
    found = leakage.collisions(left, right, ["k"], "id", "id")
    return found.select("id", "k", F.array_join(F.transform("others", lambda i: i.cast("string")), ",").alias("others"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations without a rich supplier."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").alias("c_nationkey"))
    return leakage.without(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), rich, ["c_nationkey"])


@query("SELECT n_regionkey AS family, n_name AS alias FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9800)")
def alias_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of regions in which one nation has a very rich supplier."""
    nations = table(spark, sf_dir, "nation")
    observed = nations.join(table(spark, sf_dir, "supplier").where("s_acctbal > 9800"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("alias"))
    return leakage.families(nations.select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("alias")), observed)


# Policies over entities, contacts and components.

_ENTITIES_SQL = """e AS (SELECT l_orderkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'address' ELSE 'email' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'rules' ELSE 'model' END AS source,
  CAST(CAST(0.7 AS DOUBLE) + l_discount * 2 AS FLOAT) AS confidence FROM lineitem)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 4
    kind = F.when(line == 0, "person").when(line == 1, "org").when(line == 2, "address").otherwise("email")
    source = F.when(F.col("l_returnflag") == "A", "rules").otherwise("model")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), kind.alias("kind"), source.alias("source"), (F.lit(0.7) + F.col("l_discount") * 2).cast("float").alias("confidence"))


@query(
    f"""WITH {_ENTITIES_SQL} SELECT id, kind, source, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM e
WHERE source = 'rules' OR confidence >= CASE kind WHEN 'person' THEN CAST(0.85 AS FLOAT) WHEN 'org' THEN CAST(0.8 AS FLOAT) WHEN 'address' THEN CAST(0.85 AS FLOAT) ELSE CAST(0 AS FLOAT) END"""
)
def detector_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entities of models and rules, those that are sure enough for their kind."""
    return policy.detector_thresholds(_entities(spark, sf_dir)).withColumn("confidence", policy.shown(F.col("confidence")))


@query(
    f"""WITH {_ENTITIES_SQL}, c AS (SELECT id, kind, CAST((confidence - CAST(0.4 AS FLOAT)) AS FLOAT) AS confidence FROM e)
SELECT id, kind, confidence >= CAST(0.5 AS FLOAT) AS kept, confidence < CAST(0.85 AS FLOAT) AS review_recommended FROM c"""
)
def contact_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as contacts: kept ones, and those whose members go."""
    rows = _entities(spark, sf_dir).select("id", "kind", (F.col("confidence") - F.lit(0.4).cast("float")).cast("float").alias("confidence"))
    kept, gone = policy.contact_bands(rows)
    both = kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
    return both.select("id", "kind", "kept", "review_recommended")


_PARTS_SQL = """c AS (SELECT l_orderkey AS id, ['house_number', 'road', 'suburb', 'suburb', 'city', 'postcode'][CAST(sum(l_suppkey) % 6 AS INT) + 1] AS label, l_linenumber * 10 AS start, l_linenumber * 10 + 10 AS "end",
  CAST(max(l_discount) * 10 AS FLOAT) AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as touching components of an address each order is."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_suppkey").alias("s"), F.max("l_discount").alias("d"))
    label = F.element_at(F.array(*map(F.lit, ("house_number", "road", "suburb", "suburb", "city", "postcode"))), (F.col("s") % 6).cast("int") + 1)
    return items.select(F.col("l_orderkey").alias("id"), label.alias("label"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 10).alias("end"), (F.col("d") * 10).cast("float").alias("confidence"))


@query(
    f"""WITH {_PARTS_SQL}, m AS (SELECT *, CASE WHEN confidence >= CAST(0.5 AS FLOAT) THEN label ELSE 'unknown' END AS l FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id, l ORDER BY confidence DESC, start DESC) AS r FROM m)
SELECT id, start, "end", CASE WHEN l IN ('house_number', 'postcode', 'country', 'city') AND r > 1 THEN 'unknown' ELSE l END AS label FROM r WHERE confidence >= CAST(0.5 AS FLOAT)"""
)
def unknown_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders, of labels that an address has once the surest."""
    return policy.unknown_components(_parts(spark, sf_dir), ["id"]).select("id", "start", "end", "label")


@query(
    f"""WITH {_PARTS_SQL}, t AS (SELECT *, CASE WHEN label = 'suburb' AND lag(label) OVER w = 'suburb' AND lag("end") OVER w = start THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY id ORDER BY start, "end")),
i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM t)
SELECT id, min(label) AS label, min(start) AS start, max("end") AS "end", round(CAST(min(confidence) AS DOUBLE), 4) AS confidence FROM i GROUP BY id, island"""
)
def merged_suburbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders, touching suburbs as one."""
    return policy.merge_suburbs(_parts(spark, sf_dir), ["id"]).withColumn("confidence", policy.shown(F.col("confidence")))


@query(f"""WITH {_PARTS_SQL} SELECT id, round(CAST(coalesce(min(CASE WHEN label <> 'city' THEN confidence END), 0) AS DOUBLE), 4) AS confidence FROM c GROUP BY id""")
def address_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least confidence of each order's components, towns taken as unknown."""
    rows = _parts(spark, sf_dir).withColumn("label", F.when(F.col("label") == "city", "unknown").otherwise(F.col("label")))
    return policy.address_confidence(rows, ["id"]).withColumn("confidence", policy.shown(F.col("confidence")))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ', ' WHEN 1 THEN ' ;' WHEN 2 THEN '、' ELSE '' END AS head, CASE p_partkey % 3 WHEN 0 THEN ' ,' WHEN 1 THEN '；。' ELSE '' END AS tail, p_name FROM part)
SELECT p_partkey, p_name AS text, CAST(10 + strlen(head) AS INTEGER) AS start, CAST(10 + strlen(head) + strlen(p_name) AS INTEGER) AS "end" FROM t WHERE p_name <> ''"""
)
def trimmed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts between separators, without them."""
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, ", ").when(k % 4 == 1, " ;").when(k % 4 == 2, "、").otherwise("")
    tail = F.when(k % 3 == 0, " ,").when(k % 3 == 1, "；。").otherwise("")
    text = F.concat(head, "p_name", tail)
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.lit(10).alias("start"), (F.lit(10) + F.octet_length(text)).alias("end"))
    return policy.trim_components(rows)


# Keys, names, shapes.


@query(
    r"""SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN 'url:' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
  || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END AS key FROM pages"""
)
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages are recognised by: none has a document number, so their addresses."""
    return table(spark, sf_dir, "pages").select("page_id", urls.document_key(F.col("url")).alias("key"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS surface FROM documents WHERE text IS NOT NULL AND n_chars < 400"""
)
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents as surfaces are compared: composed, lower case, single spaces."""
    from gleaner.arrow import per_text

    rows = table(spark, sf_dir, "documents").where("text is not null and n_chars < 400")
    return per_text(rows, [F.col("text")], texts.normalise_surface, "string", "surface", ["doc_id"])


_NAMES_SQL = "n AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' No 7' WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN upper(left(p_name, 1)) || p_name || ' and sons of LEI' ELSE p_name END AS name FROM part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    made: Column = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" No 7"))).when(k == 2, F.replace(name, F.lit(" "), F.lit("")))
    made = made.when(k == 3, F.concat(F.upper(F.left(name, F.lit(1))), name, F.lit(" and sons of LEI"))).otherwise(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("name"))


@query(rf"WITH {_NAMES_SQL} SELECT id, name FROM n WHERE NOT regexp_matches(name, '[0-9]') AND octet_length(encode(name)) <= 60 AND len(string_split_regex(trim(name), '\s+')) >= 2")
def clean_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that could be people's."""
    return generate.clean_people(_names(spark, sf_dir))


@query(rf"WITH {_NAMES_SQL} SELECT id, name FROM n WHERE octet_length(encode(name)) >= 3 AND NOT regexp_matches(lower(name), '\blei\b')")
def clean_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that could be organizations'."""
    return generate.clean_organizations(_names(spark, sf_dir))


@query(
    rf"""WITH {_NAMES_SQL} SELECT id, CASE WHEN regexp_matches(name, '^[A-Z][A-Z0-9&.-]{{1,9}}$') THEN 'acronym' WHEN len(string_split_regex(trim(name), '\s+')) >= 4 THEN 'long_name' ELSE 'other' END AS shape,
  regexp_matches(name, '[A-Za-z]') AND lower(name) <> name AS plausible FROM n"""
)
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts by shape, and whether they could be spans."""
    return _names(spark, sf_dir).select("id", texts.organization_shape(F.col("name")).alias("shape"), texts.plausible_span(F.col("name")).alias("plausible"))


# Joins of places, intervals and prefixes.


@query(
    """WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0), m AS (SELECT event_id AS mark, user_id, ts FROM events WHERE event_id % 3 > 0)
SELECT r.event_id, (SELECT mark FROM m WHERE m.user_id = r.user_id AND m.ts <= r.ts ORDER BY m.ts DESC, mark DESC LIMIT 1) AS mark FROM r"""
)
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event with the last of the others of its user at or before it."""
    events = table(spark, sf_dir, "events")
    marks = events.where("event_id % 3 > 0").select("user_id", "ts", F.col("event_id").alias("mark"))
    return joins.as_of(events.where("event_id % 3 = 0").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "ts", "mark").select("event_id", "mark")


@query(
    """WITH r AS (SELECT event_id, user_id FROM events WHERE event_id % 3 = 0), m AS (SELECT event_id AS mark, user_id FROM events WHERE event_id % 3 > 0),
b AS (SELECT r.*, (SELECT max(mark) FROM m WHERE m.user_id = r.user_id AND mark <= event_id) AS back, (SELECT min(mark) FROM m WHERE m.user_id = r.user_id AND mark >= event_id) AS forth FROM r)
SELECT event_id, CASE WHEN back IS NOT NULL AND event_id - back <= 400 AND (forth IS NULL OR event_id - back <= forth - event_id) THEN back WHEN forth - event_id <= 400 THEN forth END AS mark FROM b"""
)
def nearest_within_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event with the nearest of the others of its user, if it is near enough."""
    events = table(spark, sf_dir, "events")
    marks = events.where("event_id % 3 > 0").select("user_id", F.col("event_id").alias("place"))
    return joins.nearest(events.where("event_id % 3 = 0").select("event_id", "user_id"), marks, ["user_id"], "event_id", "place", 400).select("event_id", "mark")


_PLAN = (("1", "a"), ("12", "b"), ("1x3", "c"), ("9xx", "d"), ("45", "e"), ("45x7", "f"), ("0", "g"), ("6x", "h"), ("61", "i"))


@query(
    f"""WITH p(prefix, region) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PLAN)}), n AS (SELECT o_orderkey, CAST(o_custkey * 7919 % 1000003 AS VARCHAR) AS number FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(prefix) DESC, prefix) AS r FROM n JOIN p ON regexp_matches(number, '^' || replace(prefix, 'x', '[0-9]')))
SELECT o_orderkey, number, prefix, region FROM m WHERE r = 1"""
)
def numbering_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made of customers by the longest prefix of a small plan with wildcards."""
    numbers = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7919 % 1000003).cast("string").alias("number"))
    return joins.prefix_join(numbers, spark.createDataFrame(list(_PLAN), "prefix string, region string"), "number", "prefix")


@query(
    """WITH a AS (SELECT l_orderkey AS doc, l_partkey AS start, l_partkey + l_linenumber * 20 AS "end" FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey AS doc, l_partkey AS start, l_partkey + l_linenumber * 20 AS "end" FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT doc, start, "end" FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND a.start < b."end" AND b.start < a."end")"""
)
def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even items whose interval meets one of an odd item of their order."""
    items = table(spark, sf_dir, "lineitem")
    spans = items.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") * 20).alias("end"), "l_linenumber")
    return rules.semi_overlap(spans.where("l_linenumber % 2 = 0").drop("l_linenumber"), spans.where("l_linenumber % 2 = 1").drop("l_linenumber"), ["doc"])
