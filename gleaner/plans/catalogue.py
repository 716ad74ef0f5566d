"""The query catalogue: name -> callable(spark, sf_dir), and name -> DuckDB SQL of the same rows. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.functions import text as texts
from gleaner.functions.hashing import fnv1a_sql
from gleaner.functions.offsets import matches, utf16_offset
from gleaner.operators import dedup, features, leakage, lines, metrics, policy, regions, rules, splits, tokens
from gleaner.plans import api
from gleaner.plans.registry import ORACLES, QUERIES, query
from gleaner.plans.registry import table as _table
from gleaner.tables import written

_SHOWN = ["doc_id", "kind", "start", "end", "text", "normalized"]

# What emails look like to SQL: the scanner's grammar but for addresses that touch others.
_LOCAL = "[A-Za-z0-9!#$%&''+/?^_~.-]+"
_EMAIL_SQL = f"""
m AS (SELECT doc_id, text, regexp_extract_all(text, '{_LOCAL}@[A-Za-z0-9.-]+') AS found, string_split_regex(text, '{_LOCAL}@[A-Za-z0-9.-]+') AS gaps FROM documents WHERE contains(text, '@')),
u AS (SELECT doc_id, found[i] AS raw, gaps[i] AS before, gaps[i + 1] AS after,
  list_sum(list_transform(gaps[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: strlen(g))), 0) AS pos FROM m, unnest(range(1, len(found) + 1)) AS t(i)),
c AS (SELECT doc_id, pos + strlen(raw) - strlen(ltrim(raw, '''')) AS start, rtrim(ltrim(raw, ''''), '.,;:)]>''"-') AS text, before, after FROM u),
e AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + strlen(text) AS INTEGER) AS "end", text, split_part(text, '@', 1) || '@' || lower(split_part(text, '@', 2)) AS normalized,
  CASE WHEN regexp_matches(text, '\\.[A-Za-z]{{2,24}}$') THEN 0.99 ELSE 0.7 END AS confidence FROM c
  WHERE regexp_matches(text, '^[^.@][^@]*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$') AND NOT contains(split_part(text, '@', 1), '..')
  AND length(split_part(text, '@', 1)) <= 64 AND NOT regexp_matches(text, '\\.@') AND NOT regexp_matches(before, '[@/\\\\]$') AND NOT starts_with(text, '/')
  AND NOT starts_with(after, '@') AND NOT regexp_matches(before, '://[^[:space:]]*$'))"""


@query(f"WITH {_EMAIL_SQL} SELECT doc_id, start, \"end\", text, normalized, confidence, confidence < 0.85 AS review_recommended FROM e")
def email_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email addresses of all documents, with bands."""
    found = api.detect(_table(spark, sf_dir, "documents").where(F.col("text").contains("@")), ["doc_id"], api.Options(kinds=("email",)))
    return found.select("doc_id", "start", "end", "text", "normalized", policy.shown(F.col("confidence")).alias("confidence"), "review_recommended")


@query(f"WITH {_EMAIL_SQL} SELECT split_part(normalized, '@', 2) AS domain, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1")
def email_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and documents by domain."""
    found = email_entities(spark, sf_dir)
    return found.groupBy(F.substring_index("normalized", "@", -1).alias("domain")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query()
def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails and phones of all documents, national numbers read in the regions that each text points to."""
    found = rules.rule_entities(_table(spark, sf_dir, "documents"), ["doc_id"])
    return policy.bands(found).select(*_SHOWN, "region", policy.shown(F.col("confidence")).alias("confidence"), "review_recommended")


@query()
def phone_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers of all documents as read in the United States."""
    found = api.detect(_table(spark, sf_dir, "documents"), ["doc_id"], api.Options(kinds=("phone",), country_hint=("US",)))
    return found.select(*_SHOWN, "region", policy.shown(F.col("confidence")).alias("confidence"), "review_recommended")


_NANP = r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}"


@query(
    f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_NANP}') AS found, string_split_regex(text, '{_NANP}') AS gaps FROM documents),
u AS (SELECT doc_id, found[i] AS text, gaps[i] AS before, gaps[i + 1] AS after,
  list_sum(list_transform(gaps[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: strlen(g))), 0) AS start FROM m, unnest(range(1, len(found) + 1)) AS t(i))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + strlen(text) AS INTEGER) AS "end", text, '+' || regexp_replace(text, '[^0-9]', '', 'g') AS normalized FROM u
WHERE NOT regexp_matches(before, '[$€£¥円₾%] ?$') AND NOT regexp_matches(after, '^ ?[$€£¥円₾%]')"""
)
def phone_nanp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers of the North American plan written in full."""
    found = rule_entities(spark, sf_dir).where("kind = 'phone'")
    return found.where(F.col("text").rlike(f"^{_NANP}$")).select("doc_id", "start", "end", "text", "normalized")


_DIGITS, _ADDRESS = "[0-9][0-9 ().-]{5,20}[0-9]", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]"


def _offsets_sql(name: str, pattern: str) -> str:
    return f"""{name}0 AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM documents),
{name} AS (SELECT doc_id, found[i] AS text, CAST(list_sum(list_transform(gaps[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: strlen(g))), 0) AS INTEGER) AS start FROM {name}0, unnest(range(1, len(found) + 1)) AS t(i))"""


def _offsets(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.select("doc_id", F.explode(matches(F.col("text"), pattern)).alias("m")).select("doc_id", "m.*")


@query(
    f"""WITH {_offsets_sql("p", _DIGITS)}, {_offsets_sql("e", _ADDRESS)}
SELECT doc_id, start, start + CAST(strlen(text) AS INTEGER) AS "end", text FROM p WHERE NOT EXISTS (
  SELECT 1 FROM e WHERE e.doc_id = p.doc_id AND p.start < e.start + strlen(e.text) AND e.start < p.start + strlen(p.text))"""
)
def rule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits that overlap no address: an interval anti-join with native offsets."""
    docs = _table(spark, sf_dir, "documents")
    return rules.anti_overlap(_offsets(docs, _DIGITS), _offsets(docs, _ADDRESS), ["doc_id"])


@query()
def region_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that documents point to, ranked."""
    return regions.votes(_table(spark, sf_dir, "documents"), ["doc_id"])


@query(
    """SELECT doc_id, CAST(round(c, 4) AS DOUBLE) AS confidence, CAST(c AS FLOAT) < CAST(0.85 AS FLOAT) AS review_recommended
FROM (SELECT doc_id, CAST((n_chars % 101) / 100.0 AS DOUBLE) AS c FROM documents) WHERE CAST(c AS FLOAT) >= CAST(0.5 AS FLOAT)"""
)
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands over confidences that the lengths of documents stand in for."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / 100.0).alias("confidence"))
    return policy.bands(rows).withColumn("confidence", F.round("confidence", 4))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one of equal text."""
    return dedup.duplicates(_table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


def _shingles_sql(table: str, id_col: str, words: str, n: int) -> str:
    return f"""SELECT DISTINCT {id_col} AS id, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT {id_col}, {words} AS w FROM {table}), unnest(range(1, len(w) - {n - 2})) AS t(i)"""


_WORDS_SQL = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
_ASCII_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(
    f"""WITH s AS ({_shingles_sql("documents", "doc_id", _WORDS_SQL, 7)}),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 5),
p AS (SELECT b.id, a.id AS prior, count(*) AS shared FROM s AS a JOIN s AS b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT p.id, min(prior) AS prior FROM p JOIN n AS x ON x.id = p.id JOIN n AS y ON y.id = p.prior WHERE shared >= 0.8 * least(x.n, y.n) - 1e-9 GROUP BY p.id"""
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share four fifths of their seven-word shingles with an earlier one, and the first such."""
    return dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", texts.words(F.col("text")))


@query(
    f"""WITH d AS ({_shingles_sql("documents", "doc_id", _ASCII_SQL, 12)}), b AS ({_shingles_sql("benchmark", "item_id", _ASCII_SQL, 12)}),
p AS (SELECT DISTINCT d.id AS doc_id, b.id AS item FROM d JOIN b ON d.s = b.s)
SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM p GROUP BY doc_id"""
)
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share twelve words in a row with benchmark items."""
    found = leakage.prose_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


_KEY_SQL = "coalesce(source, '') || ':' || doc_id"
_BUCKET_SQL = f"SELECT doc_id, {fnv1a_sql(_KEY_SQL)} AS h, {fnv1a_sql(_KEY_SQL, 0x9E37)} AS k FROM documents"


@query(
    f"""SELECT doc_id, CASE CAST(h % 12 AS INTEGER) WHEN 10 THEN 'valid' WHEN 11 THEN 'test' ELSE 'train' END AS split,
CASE WHEN h % 100 < 90 THEN 'train' WHEN h % 100 < 95 THEN 'valid' ELSE 'test' END AS name_split, k % 1000 < 250 AS kept FROM ({_BUCKET_SQL})"""
)
def fnv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and keep flags by hashed keys of source and id."""
    key = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", splits.split_12(key).alias("split"), splits.split_100(key).alias("name_split"), splits.keep_some(key, 250).alias("kept"))


@query(f"SELECT page_id, url, {urls.URL_KEY_SQL} AS url_key, count(*) OVER (PARTITION BY {urls.URL_KEY_SQL}) AS n FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses of pages, and how many share each."""
    keyed = _table(spark, sf_dir, "pages").select("page_id", "url", urls.url_key(F.col("url")).alias("url_key"))
    counted = keyed.groupBy("url_key").agg(F.count("*").alias("n")).withColumnRenamed("url_key", "__k")
    return keyed.join(counted, F.col("url_key").eqNullSafe(F.col("__k"))).drop("__k")


_SLUG_SQL = r"trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT array_to_string(string_split({_SLUG_SQL}, '-')[1:8], '-') AS family, count(*) AS pages, min(page_id) AS first FROM pages GROUP BY 1")
def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first eight words of their addresses."""
    slug = F.trim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), F.lit("-"))
    pages = _table(spark, sf_dir, "pages").select("page_id", urls.source_family(slug).alias("family"))
    return pages.groupBy("family").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query(f"SELECT page_id, {html.PLAIN_SQL.format('html')} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup, paragraphs unwrapped."""
    return _table(spark, sf_dir, "pages").select("page_id", html.plain(F.col("html")).alias("text"))


_CLOSINGS_SQL = ", ".join(f"'{c}'" for c in lines.CLOSINGS)
_TRIM = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_KIND_SQL = rf"""CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '{lines.SEPARATOR_LINE}') THEN 'separator'
  WHEN starts_with(t, '>') AND regexp_replace(t[2:], {_TRIM}) = '' THEN 'quoted_blank' WHEN starts_with(t, '>') THEN 'quoted'
  WHEN regexp_matches(t, '{lines.CHAT_LINE}') THEN 'chat_turn'
  WHEN length(t) - length(replace(t, '|', '')) >= 2 OR length(line) - length(replace(line, chr(9), '')) >= 2 THEN 'table_row'
  WHEN regexp_matches(t, '{lines.HEADER_LINE}') THEN 'header'
  WHEN lower(regexp_replace(regexp_replace(t, '[,.!]+$', ''), {_TRIM})) IN ({_CLOSINGS_SQL}) THEN 'closing' ELSE 'text' END"""


@query(
    rf"""WITH r AS (SELECT conv_id, turn, string_split_regex(text, '\r\n|[\n\r\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM conversations),
l AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line, regexp_replace(parts[i], {_TRIM}) AS t
  FROM r, unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS x(i)),
k AS (SELECT *, {_KIND_SQL} AS kind FROM l)
SELECT conv_id, turn, line_no, length(line) AS n_chars, kind FROM k"""
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every turn, by kind."""
    found = lines.classified(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "line_no", F.length("line").cast("long").alias("n_chars"), "kind")


_BREAK_SQL = r"'\r\n|[\n\r\x{85}\x{2028}\x{2029}]'"


@query(
    # Whether a line goes on in the block before it is told by the line before it.
    rf"""WITH r AS (SELECT doc_id, string_split_regex(text, {_BREAK_SQL}) AS parts, regexp_extract_all(text, {_BREAK_SQL}) AS seps FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, parts[i] AS line, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(seps[1:i - 1], lambda x: strlen(x))), 0) AS start,
  regexp_replace(parts[i], {_TRIM}) AS t FROM r, unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS x(i)),
k AS (SELECT *, {_KIND_SQL} AS kind FROM l),
p AS (SELECT *, lag(kind) OVER w AS before, sum(CASE WHEN kind IN ('blank', 'quoted_blank') THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS blanks FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, CASE WHEN kind = 'header' THEN before IS DISTINCT FROM 'header' WHEN kind = 'quoted' THEN before IS DISTINCT FROM 'quoted' WHEN kind IN ('text', 'closing') THEN coalesce(before, '') NOT IN ('text', 'closing', 'chat_turn') ELSE TRUE END AS opens,
  blanks - coalesce(lag(blanks) OVER (PARTITION BY doc_id ORDER BY i), 0) AS gap FROM p WHERE kind NOT IN ('blank', 'quoted_blank')),
b AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) - 1 AS block_no FROM n),
g AS (SELECT doc_id, block_no, arg_min(kind, i) AS first, min(start) AS start, max(start + strlen(line)) AS "end", count(*) AS n_lines, arg_min(gap, i) AS gap_lines,
  count(*) FILTER (kind IN ('text', 'quoted', 'chat_turn', 'header')) >= {lines.SIGNATURE_LINES} AND coalesce(bool_and(length(t) <= {lines.SHORT_CHARS}) FILTER (kind IN ('text', 'quoted', 'chat_turn', 'header')), TRUE) AS short FROM b GROUP BY 1, 2)
SELECT doc_id, block_no, CASE WHEN first IN ('text', 'closing') THEN CASE WHEN short THEN 'signature' ELSE 'paragraph' END WHEN first = 'quoted' THEN 'quoted_reply' ELSE first END AS kind,
  CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(n_lines AS INTEGER) AS n_lines, short AS short_lines, CAST(gap_lines AS INTEGER) AS gap_lines FROM g"""
)
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines of all documents."""
    return lines.blocks(_table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by class and script."""
    return tokens.counts(_table(spark, sf_dir, "documents"))


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS docs FROM documents WHERE text IS NOT NULL")
def token_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that tokens cover: all of them."""
    return tokens.covered(_table(spark, sf_dir, "documents"))


@query()
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each turn have each flag, and which n-grams."""
    found = features.token_features(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    flags = [F.sum((F.col("flags").bitwiseAND(F.lit(bit)) != 0).cast("int")).alias(name) for name, bit in features.BIT.items()]
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.size("ngram_ids")).alias("ngrams"), *flags)


@query()
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of contacts found in all documents, and what belongs to none."""
    return api.contact_members(api.extract_contacts(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


#: Streets of made-up addresses: (name, word).
_ROADS = (("Oak", "Street"), ("Main", "Avenue"), ("Elm", "Road"), ("Cedar", "Drive"), ("Lake", "Lane"))
_CITIES = (("Denver", "CO"), ("Salem", "OR"), ("Austin", "TX"), ("Boston", "MA"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address of the United States for each customer, by rule."""
    pick = lambda rows, of: F.element_at(F.array(*[F.lit(of(r)) for r in rows]), (F.col("c_custkey") % len(rows)).cast("int") + 1)
    number, code = (F.col("c_custkey") % 9000 + 1).cast("string"), F.lpad((F.col("c_custkey") * 37 % 90000 + 10000).cast("string"), 5, "0")
    road, city, state = pick(_ROADS, " ".join), pick(_CITIES, lambda c: c[0]), pick(_CITIES, lambda c: c[1])
    text = F.concat(number, F.lit(" "), road, F.lit(", "), city, F.lit(", "), state, F.lit(" "), code)
    return _table(spark, sf_dir, "customer").select("c_custkey", text.alias("address"))


_ROADS_SQL = "[" + ", ".join(f"'{' '.join(r)}'" for r in _ROADS) + "]"
_CITIES_SQL, _STATES_SQL = ("[" + ", ".join(f"'{c[k]}'" for c in _CITIES) + "]" for k in (0, 1))


@query(
    f"""WITH p AS (SELECT c_custkey, CAST(c_custkey % 9000 + 1 AS VARCHAR) AS house_number, {_ROADS_SQL}[c_custkey % {len(_ROADS)} + 1] AS road, {_CITIES_SQL}[c_custkey % {len(_CITIES)} + 1] AS city,
  {_STATES_SQL}[c_custkey % {len(_CITIES)} + 1] AS region, CAST(c_custkey * 37 % 90000 + 10000 AS VARCHAR) AS postcode FROM customer),
o AS (SELECT *, length(house_number) + 1 AS r, length(house_number) + length(road) + 3 AS c, length(house_number) + length(road) + length(city) + 5 AS s FROM p),
k AS (SELECT c_custkey, unnest([struct_pack(label := 'house_number', start := 0, text := house_number), struct_pack(label := 'road', start := r, text := road), struct_pack(label := 'city', start := c, text := city),
  struct_pack(label := 'region', start := s, text := region), struct_pack(label := 'postcode', start := s + 3, text := postcode)]) AS x FROM o)
SELECT c_custkey, x.label, CAST(x.start AS INTEGER) AS start, CAST(x.start + length(x.text) AS INTEGER) AS "end" FROM k"""
)
def parsed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of an address for each customer."""
    parsed = api.parse_address(_addresses(spark, sf_dir), ["c_custkey"], text_col="address", country=F.lit("US"))
    return parsed.select("c_custkey", F.explode_outer("components").alias("c")).select("c_custkey", "c.label", "c.start", "c.end")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a stand-in confidence."""
    rows = _table(spark, sf_dir, "labels").where("quality is not null")
    return rows.select((F.col("doc_id") * 37 % 100 / 100.0).alias("confidence"), "quality")


@query(
    """WITH r AS (SELECT CAST((doc_id * 37 % 100) / 100.0 AS DOUBLE) AS c, quality FROM labels WHERE quality IS NOT NULL),
b AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS confidence, avg(CAST(quality AS DOUBLE)) AS accuracy FROM r GROUP BY 1)
SELECT bin, n, round(confidence, 8) AS confidence, round(accuracy, 8) AS accuracy, round(sum(n * abs(confidence - accuracy)) OVER () / sum(n) OVER (), 8) AS ece FROM b"""
)
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of a stand-in confidence against quality labels."""
    found = metrics.calibration(_judged(spark, sf_dir), "confidence", "quality")
    return found.select("bin", "n", *[F.round(c, 8).alias(c) for c in ("confidence", "accuracy", "ece")])


_RATIO = "coalesce(round(CAST({} AS DOUBLE) / nullif({}, 0), 4), 0)"


def _prf_sql(tp: str, predicted: str, gold: str) -> str:
    return f"{_RATIO.format(tp, predicted)} AS precision, {_RATIO.format(tp, gold)} AS recall, {_RATIO.format('2 * ' + tp, '(' + predicted + ' + ' + gold + ')')} AS f1"


@query(
    f"""WITH r AS (SELECT CAST((doc_id * 37 % 100) / 100.0 AS DOUBLE) AS s, quality FROM labels WHERE quality IS NOT NULL),
c AS (SELECT t AS threshold, CAST(sum(CASE WHEN s >= t THEN quality ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= t THEN 1 ELSE 0 END) AS BIGINT) AS predicted, CAST(sum(quality) AS BIGINT) AS gold
  FROM r, unnest([0.6::DOUBLE, 0.7, 0.8, 0.9]) AS x(t) GROUP BY t)
SELECT *, {_prf_sql("tp", "predicted", "gold")} FROM c"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a stand-in score at four thresholds."""
    return metrics.threshold_sweep(_judged(spark, sf_dir), "confidence", "quality")


# Spans to score: names are capitalised words; predictions are made of them by hashes that both engines share.
_NAME = "[A-Z][a-z]+"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = written(_offsets(_table(spark, sf_dir, "documents"), _NAME), "names")
    gold = found.select("doc_id", F.when(F.length("text") > 6, "org").otherwise("person").alias("kind"), "start", "end")
    mark = F.pmod(F.col("start") * 7 + F.col("doc_id"), F.lit(10))
    kind = F.when(mark == 1, F.when(F.col("kind") == "org", "person").otherwise("org")).otherwise(F.col("kind"))
    start = F.when(mark == 2, F.col("start") + 1).when(mark == 3, F.col("start") + 100_000).otherwise(F.col("start"))
    moved = gold.where(mark != 4).withColumn("mark", mark).select("doc_id", kind.alias("kind"), start.alias("start"), F.when(mark == 3, F.col("end") + 100_000).otherwise(F.col("end")).alias("end"), "mark")
    twice = moved.withColumn("n", F.explode(F.when(F.col("mark") == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return gold, twice.drop("mark", "n")


_SPANS_SQL = f"""{_offsets_sql("w", _NAME)},
gold AS (SELECT doc_id, CASE WHEN length(text) > 6 THEN 'org' ELSE 'person' END AS kind, start, start + CAST(strlen(text) AS INTEGER) AS "end", (start * 7 + doc_id) % 10 AS mark FROM w),
pred AS (SELECT doc_id, CASE WHEN mark = 1 THEN CASE kind WHEN 'org' THEN 'person' ELSE 'org' END ELSE kind END AS kind, start + CASE mark WHEN 2 THEN 1 WHEN 3 THEN 100000 ELSE 0 END AS start,
  "end" + CASE mark WHEN 3 THEN 100000 ELSE 0 END AS "end", n FROM gold, unnest(CASE WHEN mark = 5 THEN [1, 2] ELSE [1] END) AS t(n) WHERE mark <> 4),
hits AS (SELECT p.doc_id, p.kind, p.start, p."end", CASE WHEN g.m IS NULL THEN 0 ELSE 1 END AS matched
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS k FROM pred) AS p
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS m FROM gold) AS g ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.start = p.start AND g."end" = p."end" AND g.m = p.k)"""


@query(
    f"""WITH {_SPANS_SQL},
r AS (SELECT kind, 0 AS gold, 1 AS predicted, matched AS tp FROM hits UNION ALL SELECT kind, 1, 0, 0 FROM gold),
c AS (SELECT kind, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM r GROUP BY GROUPING SETS ((kind), ()))
SELECT *, {_prf_sql("tp", "predicted", "gold")} FROM c"""
)
def prf_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores by kind and over all, each gold span used once."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.exact_score(gold, predicted, ["kind"], ["doc_id", "kind", "start", "end"])


@query(
    f"""WITH {_SPANS_SQL},
c AS (SELECT h.*, CASE WHEN matched = 1 THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM gold AS g WHERE g.doc_id = h.doc_id AND g.kind = h.kind AND g.start = h.start AND g."end" = h."end") THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM gold AS g WHERE g.doc_id = h.doc_id AND g.kind = h.kind AND h.start < g."end" AND g.start < h."end") THEN 'boundary'
  WHEN EXISTS (SELECT 1 FROM gold AS g WHERE g.doc_id = h.doc_id AND h.start < g."end" AND g.start < h."end") THEN 'wrong_kind' ELSE 'no_overlap' END AS error FROM hits AS h)
SELECT kind, error, count(*) AS n FROM c GROUP BY 1, 2"""
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with predictions, by kind."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.error_classes(gold, predicted, "doc_id").groupBy("kind", "error").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SPANS_SQL},
lp AS (SELECT kind, count(*) AS n FROM pred AS p WHERE EXISTS (SELECT 1 FROM gold AS g WHERE g.doc_id = p.doc_id AND g.kind = p.kind AND p.start < g."end" AND g.start < p."end") GROUP BY 1),
lg AS (SELECT kind, count(*) AS n FROM gold AS g WHERE EXISTS (SELECT 1 FROM pred AS p WHERE g.doc_id = p.doc_id AND g.kind = p.kind AND p.start < g."end" AND g.start < p."end") GROUP BY 1),
r AS (SELECT kind, (SELECT count(*) FROM gold AS g WHERE g.kind = k.kind) AS gold, (SELECT count(*) FROM pred AS p WHERE p.kind = k.kind) AS predicted,
  coalesce((SELECT n FROM lg WHERE lg.kind = k.kind), 0) AS lenient_gold, coalesce((SELECT n FROM lp WHERE lp.kind = k.kind), 0) AS lenient_predicted FROM (SELECT DISTINCT kind FROM gold) AS k),
s AS (SELECT *, {_RATIO.format("lenient_predicted", "predicted")} AS precision, {_RATIO.format("lenient_gold", "gold")} AS recall FROM r)
SELECT *, {_RATIO.format("2 * precision * recall", "(precision + recall)")} AS f1 FROM s"""
)
def lenient_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the same kind, counted on either side."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.lenient_score(gold, predicted, "doc_id")


@query(
    f"""WITH {_SPANS_SQL}, c AS (SELECT kind, count(*) AS predicted, sum(matched) AS tp, (SELECT count(*) FROM gold AS g WHERE g.kind = h.kind) AS gold FROM hits AS h GROUP BY kind)
SELECT sum({_RATIO.format("2 * tp", "(predicted + gold)")}) / 3 AS macro_f1 FROM c WHERE kind IN ('person', 'org', 'address')"""
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean F1 of exact spans over kinds, one of which neither side has."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.macro_f1(gold, predicted, ["doc_id", "kind", "start", "end"])


@query(
    f"""WITH {_SPANS_SQL},
r AS (SELECT doc_id % 3 AS country, kind AS label, 0 AS gold, 1 AS predicted, matched AS tp FROM hits UNION ALL SELECT doc_id % 3, kind, 1, 0, 0 FROM gold),
c AS (SELECT country, label, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM r GROUP BY GROUPING SETS ((label), (country), ()))
SELECT *, {_prf_sql("tp", "predicted", "gold")} FROM c"""
)
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores by label, by a stand-in for country and over all."""
    sides = (rows.withColumnRenamed("kind", "label").withColumn("country", F.col("doc_id") % 3) for rows in _spans(spark, sf_dir))
    return metrics.component_scores(*sides, "doc_id")


@query(
    f"""WITH {_SPANS_SQL},
back AS (SELECT g.doc_id, g.kind, g.start, g."end", CASE WHEN p.m IS NULL THEN 0 ELSE 1 END AS matched FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS k FROM gold) AS g
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS m FROM pred) AS p ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.start = p.start AND g."end" = p."end" AND p.m = g.k),
both_ways AS (SELECT 'predicted' AS side, * FROM hits UNION ALL SELECT 'gold', * FROM back),
others AS (SELECT 'predicted' AS side, doc_id, kind, start, "end" FROM gold UNION ALL SELECT 'gold', doc_id, kind, start, "end" FROM pred),
c AS (SELECT h.side, h.kind, CASE WHEN matched = 1 THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM others AS g WHERE g.side = h.side AND g.doc_id = h.doc_id AND g.kind = h.kind AND g.start = h.start AND g."end" = h."end") THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM others AS g WHERE g.side = h.side AND g.doc_id = h.doc_id AND g.kind = h.kind AND h.start < g."end" AND g.start < h."end") THEN 'boundary'
  WHEN EXISTS (SELECT 1 FROM others AS g WHERE g.side = h.side AND g.doc_id = h.doc_id AND h.start < g."end" AND g.start < h."end") THEN 'wrong_kind' ELSE 'no_overlap' END AS error FROM both_ways AS h)
SELECT side, kind, error, count(*) AS n FROM c GROUP BY ALL"""
)
def errors_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with predictions and what became of gold spans, by kind."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.errors_both_ways(gold, predicted, "doc_id").groupBy("side", "kind", "error").agg(F.count("*").alias("n"))


@query(
    # A prediction is within the span that it was made of and gold spans are apart: the largest matching has each gold span that any prediction of its kind overlaps.
    f"""WITH {_SPANS_SQL} SELECT kind, count(*) AS matched FROM gold AS g
WHERE EXISTS (SELECT 1 FROM pred AS p WHERE p.doc_id = g.doc_id AND p.kind = g.kind AND p.start < g."end" AND g.start < p."end") GROUP BY kind"""
)
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matchings of overlapping spans, by kind."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.one_to_one(gold, predicted, "doc_id").where("matched > 0").groupBy("kind").agg(F.sum("matched").alias("matched"))


@query(
    """WITH p AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars < 200),
k AS (SELECT doc_id, lang FROM p WHERE r <= 15 UNION ALL SELECT doc_id, lang FROM documents WHERE n_chars >= 200 OR n_chars IS NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM k) SELECT doc_id, lang FROM q WHERE r <= 100"""
)
def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents of each language, at most fifteen of them short ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    short = F.coalesce(F.col("n_chars") < 200, F.lit(False))
    return splits.quotas(docs, ["lang"], ["doc_id"], 100, short).select("doc_id", "lang")


@query(
    """WITH p AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS draws, max(n_chars) AS largest FROM documents GROUP BY 1)
SELECT source, draws, largest, round(draws / CAST(sum(draws) OVER () AS DOUBLE), 4) AS share, CAST(0.5 AS DOUBLE) AS "limit", round(draws / CAST(sum(draws) OVER () AS DOUBLE), 4) <= 0.5 AS ok FROM p"""
)
def sampling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sources in all characters, against a limit of half."""
    found = metrics.sampling_audit(_table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", {})
    return found.withColumn("limit", F.lit(0.5)).withColumn("ok", F.col("share") <= 0.5)


@query(
    """WITH d AS (SELECT doc_id, source, sha256(concat_ws(':', 'review', source, CAST(doc_id AS VARCHAR))) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM d) SELECT doc_id, source FROM r WHERE r <= 25"""
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five documents of each source, by hash: a sampling operator."""
    return splits.hash_sample(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 25, "review")


@query(
    """WITH r AS (SELECT CASE WHEN n_chars >= 4096 THEN '>=4096' WHEN n_chars >= 1024 THEN '1024-4095' WHEN n_chars >= 256 THEN '256-1023' ELSE '<256' END AS bucket, n_chars / 7.0 AS ms FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY ms) AS i FROM r)
SELECT bucket, n AS cases, round(CAST(ms AS DOUBLE), 4) AS median_ms FROM k WHERE i = n // 2 + 1"""
)
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of a stand-in time, by size of document."""
    return metrics.latency(_table(spark, sf_dir, "documents").select("n_chars", (F.col("n_chars") / F.lit(7.0)).alias("ms")), "n_chars", "ms")


@query(
    """WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, 'O') ELSE 'O' END AS label, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT n AS base FROM c WHERE label = 'O')
SELECT label, round(least(5.0, sqrt(base / CAST(n AS DOUBLE))), 8) AS weight FROM c, b"""
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of languages by how much rarer than documents of no language they are."""
    counts = _table(spark, sf_dir, "documents").groupBy(F.when(F.col("doc_id") % 3 == 0, F.coalesce("lang", F.lit("O"))).otherwise("O").alias("label")).agg(F.count("*").alias("n"))
    return metrics.class_weights(counts, "label", "n").withColumn("weight", F.round("weight", 8))


@query(
    """WITH b AS (SELECT source, lang, sum(n_chars) AS m FROM documents GROUP BY 1, 2), s AS (SELECT *, m / CAST(sum(m) OVER (PARTITION BY source) AS DOUBLE) AS share FROM b)
SELECT lang, round(sum(share) / (SELECT count(DISTINCT source) FROM b), 8) AS share FROM s GROUP BY 1"""
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages' shares of characters, averaged over sources."""
    return metrics.exposure(_table(spark, sf_dir, "documents"), "source", "lang", "n_chars").withColumn("share", F.round("share", 8))


_RUN = "[0-9]{3,}"


@query(
    f"""WITH {_offsets_sql("w", _RUN)}, d AS (SELECT doc_id AS i, text AS body FROM documents)
SELECT doc_id, start, CAST(length(decode(encode(body)[1:start])) + length(regexp_replace(decode(encode(body)[1:start]), '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) AS INTEGER) AS utf16_start FROM w JOIN d ON i = doc_id"""
)
def utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of runs of digits as JavaScript counts."""
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", "text", F.explode(matches(F.col("text"), _RUN)).alias("m"))
    return found.select("doc_id", F.col("m.start").alias("start"), utf16_offset(F.col("text"), F.col("m.start")).alias("utf16_start"))


@query(
    f"""WITH {_offsets_sql("p", _RUN)}, {_offsets_sql("e", _DIGITS)}
SELECT doc_id, start, start + CAST(strlen(text) AS INTEGER) AS "end", text FROM p WHERE EXISTS (
  SELECT 1 FROM e WHERE e.doc_id = p.doc_id AND e.start <= p.start AND p.start + strlen(p.text) <= e.start + strlen(e.text))"""
)
def mask_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits that lie inside a run that looks like a phone number: an interval semi-join."""
    docs = _table(spark, sf_dir, "documents")
    return rules.semi_overlap(_offsets(docs, _RUN), _offsets(docs, _DIGITS), ["doc_id"], inside=True)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, max(CASE WHEN i = n // 2 THEN value END) AS median_ms, max(CASE WHEN i = CAST(ceil(n * 0.95) AS BIGINT) - 1 THEN value END) AS p95_ms FROM r GROUP BY event_type, n"""
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles by rank, of the values of events."""
    return metrics.stage_timings(_table(spark, sf_dir, "events").where("value is not null"), "event_type", "value")


@query(
    f"""WITH {_SPANS_SQL},
f AS (SELECT DISTINCT p.doc_id, p.kind FROM pred AS p WHERE NOT EXISTS (SELECT 1 FROM gold AS g WHERE g.doc_id = p.doc_id AND g.kind = p.kind AND p.start < g."end" AND g.start < p."end"))
SELECT kind, count(*) AS docs, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 4) AS rate FROM f GROUP BY kind"""
)
def false_positive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a prediction that overlaps nothing of its kind, as a share of all."""
    gold, predicted = _spans(spark, sf_dir)
    return metrics.false_positive_rate(gold, predicted, _table(spark, sf_dir, "documents"), "doc_id")


@query(
    f"""WITH {_SPANS_SQL},
kept AS (SELECT doc_id, kind, start, "end", row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS k FROM pred WHERE start % 100 / 100.0 >= CASE kind WHEN 'org' THEN 0.8 ELSE 0.85 END),
khits AS (SELECT p.kind, CASE WHEN g.m IS NULL THEN 0 ELSE 1 END AS matched FROM kept AS p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, start, "end") AS m FROM gold) AS g
  ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.start = p.start AND g."end" = p."end" AND g.m = p.k)
SELECT kind, (SELECT count(*) FROM gold AS g WHERE g.kind = k.kind) AS gold, (SELECT CAST(coalesce(sum(matched), 0) AS BIGINT) FROM hits AS h WHERE h.kind = k.kind) AS raw_tp,
  (SELECT count(*) FROM hits AS h WHERE h.kind = k.kind) AS raw_predicted, (SELECT CAST(coalesce(sum(matched), 0) AS BIGINT) FROM khits AS h WHERE h.kind = k.kind) AS kept_tp,
  (SELECT count(*) FROM khits AS h WHERE h.kind = k.kind) AS kept_predicted FROM (SELECT DISTINCT kind FROM gold) AS k"""
)
def raw_and_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of all predictions and of those at their kind's cutoff, with a stand-in confidence."""
    gold, predicted = _spans(spark, sf_dir)
    sure = predicted.withColumn("confidence", F.col("start") % 100 / 100.0)
    found = metrics.raw_and_kept(gold, sure, ["doc_id", "kind", "start", "end"], {"org": 0.8, "person": 0.85})
    return found.select("kind", "gold", "raw_tp", "raw_predicted", "kept_tp", "kept_predicted")


@query(
    """WITH c AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1),
o AS (SELECT DISTINCT conv_id, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS key FROM conversations JOIN c USING (conv_id) WHERE turn = t)
SELECT key, count(*) AS n, min(conv_id) AS first FROM o GROUP BY key"""
)
def opening_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening turns of conversations by their surface, and how many share each."""
    rows = _table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("t"))
    keyed = first.select("conv_id", leakage.surface_key(F.lit("org"), F.col("t.text")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


from gleaner.plans import relational  # noqa: E402, F401  registers the queries of relational operators
