"""Readers with fixed schemas: nothing is inferred, and what breaks a contract is an error, not a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.schema import ADDRESS_LABELS, KINDS

SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"
GOLD = f"name string, input string, expected {SPANS}, country string, doc_type string, source_host string"
SILVER = "id string, text string, country string, entities array<struct<kind:string,start:int,end:int>>, source string, source_url string"
REQUEST = "operation string, text string, kinds array<string>, country_hint array<string>, include_uncertain boolean, format string, offsets string"
OPERATIONS, FORMATS, OFFSETS = ("detect", "contacts", "address"), ("text", "markdown"), ("utf8", "utf16")
REQUEST_FIELDS = ("operation", "text", "kinds", "country_hint", "include_uncertain", "format", "offsets")


class ContractError(ValueError):
    """Input that breaks a reader's contract."""


def _refuse(rows: DataFrame, condition: Column, what: str) -> DataFrame:
    """rows; raises if the condition holds for any of them."""
    bad = rows.where(condition).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: {bad[0].asDict()}")
    return rows


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files, one document each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): lines of tagged addresses, also gzipped; line_no is unique and ascends within a file."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON requests, one a line. Unknown fields and values are errors, and so is an address request without that kind."""
    raw = spark.read.text(path)
    known = F.array(*map(F.lit, REQUEST_FIELDS))
    _refuse(raw, F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array()), known)) > 0, "unknown fields")
    parsed = raw.select(F.from_json("value", REQUEST, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    _refuse(parsed, ~F.coalesce(F.col("operation").isin(list(OPERATIONS)), F.lit(False)), "unknown operation")
    _refuse(parsed, F.exists(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: ~k.isin(list(KINDS))) | (F.size("kinds") == 0), "kinds")
    _refuse(parsed, (F.col("operation") == "address") & ~F.coalesce(F.array_contains("kinds", "address"), F.lit(True)), "operation address needs kind address")
    for column, values in (("format", FORMATS), ("offsets", OFFSETS)):
        _refuse(parsed, ~F.coalesce(F.col(column).isin(list(values)), F.lit(True)), column)
    _refuse(parsed, F.col("text").isNull(), "no text")
    _refuse(parsed, F.exists(F.coalesce("country_hint", F.array().cast("array<string>")), lambda h: ~F.trim(h).rlike("^[A-Za-z]{2}$")), "country_hint")
    return parsed


def _bad_span(text: Column, spans: Column, with_text: bool) -> Column:
    """Whether a span is empty, out of its text, cuts a character, or differs from the text it names."""
    data = F.encode(text, "UTF-8")

    def bad(s: Column) -> Column:
        part = F.substring(data, s["start"] + 1, s["end"] - s["start"])
        found = (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.octet_length(data)) | ~F.is_valid_utf8(part.cast("string"))
        return found | (F.coalesce(s["text"], part.cast("string")) != part.cast("string")) if with_text else found

    return F.exists(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>") if with_text else spans), bad)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases with slices: duplicate names, spans that repeat, and spans unlike their text are errors."""
    rows = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    _refuse(rows.groupBy("name").count(), F.col("count") > 1, "a name twice")
    _refuse(rows, _bad_span(F.col("input"), F.col("expected"), True), "bad span")
    _refuse(rows, F.size(F.array_distinct("expected")) < F.size("expected"), "a span twice")
    slices = F.map_filter(F.create_map(*[x for c in ("country", "doc_type", "source_host") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return rows.withColumn("slices", slices)


def silver(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents, equal texts once, the one of least id and source; equal texts with other labels are an error."""
    rows = spark.read.schema(SILVER).option("mode", "FAILFAST").json(path)
    labels = F.to_json(F.array_sort("entities"))
    _refuse(rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.countDistinct(labels).alias("n")), F.col("n") > 1, "a text with two labellings")
    one = rows.groupBy("text").agg(F.min(F.struct("id", "source", "source_url", "country", "entities")).alias("r"))
    return one.select(*[F.col("text") if c == "text" else F.col(f"r.{c}") for c in rows.columns])


def address_shard(spark: SparkSession, path: str) -> DataFrame:
    """Address examples from Parquet with three parallel lists as one array of spans; lists of unequal lengths and unknown labels are errors."""
    rows = spark.read.parquet(path)
    unequal = (F.size("span_label") != F.size("span_start")) | (F.size("span_label") != F.size("span_end")) | F.col("span_label").isNull()
    _refuse(rows.select("id", "span_label", "span_start", "span_end"), unequal | F.exists("span_label", lambda i: i.isNull() | (i < 0) | (i >= len(ADDRESS_LABELS) - 1)), "bad spans")
    names = F.array(*map(F.lit, ADDRESS_LABELS))
    zipped = F.arrays_zip("span_label", "span_start", "span_end")
    spans = F.transform(zipped, lambda s: F.struct(F.get(names, s["span_label"].cast("int")).alias("label"), s["span_start"].cast("int").alias("start"), s["span_end"].cast("int").alias("end")))
    return rows.withColumn("spans", spans).drop("span_label", "span_start", "span_end")


def synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Synthetic documents of the United States, entities from their JSON column."""
    rows = spark.read.parquet(path).where("country = 'US'")
    return rows.withColumn("entities", F.from_json("entities_json", "array<struct<kind:string,start:int,end:int>>", {"mode": "FAILFAST"})).drop("entities_json")


def predictions(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """External predictions (name, entities) aligned with cases: a case left out predicts nothing, other names are errors."""
    from gleaner.operators.metrics import align

    rows = spark.read.schema(f"name string, entities {SPANS}").option("mode", "FAILFAST").json(path)
    return align(cases, rows, "name", "entities")


NOTICE = "document_number string, title string, publication_date string, html_url string, body string"
#: Characters of contact sections that make a notice worth keeping.
LEAST_SECTIONS = 200


def notices(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, date, url, text) of landed notices, one JSON object a line with their markup: contact sections alone, of LEAST_SECTIONS characters or more, each notice once."""
    from gleaner.functions.html import notice_texts, sections

    rows = spark.read.schema(NOTICE).option("mode", "FAILFAST").json(path).where("document_number is not null and body is not null")
    one = rows.groupBy("document_number").agg(F.min(F.struct("publication_date", "title", "html_url", "body")).alias("r")).select("document_number", "r.*")
    text = one.withColumn("text", notice_texts(F.col("body"))).withColumn("text", sections(F.col("text")))
    return text.where(F.length("text") >= LEAST_SECTIONS).select(F.col("document_number").alias("id"), "title", F.col("publication_date").alias("date"), F.col("html_url").alias("url"), "text")


def external(rows: DataFrame, kinds: dict[str, str], text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """Spans of another recogniser (kind, start, end in characters) as ours: kinds mapped, unmapped ones left out, offsets in bytes."""
    ours = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    at = lambda c: F.octet_length(F.substring(F.col(text_col), F.lit(1), c)).cast("int")
    known = F.filter(spans_col, lambda s: s["kind"].isin(list(kinds)))
    return rows.withColumn(spans_col, F.transform(known, lambda s: F.struct(ours[s["kind"]].alias("kind"), at(s["start"]).alias("start"), at(s["end"]).alias("end"))))


def organizations(spark: SparkSession, path: str, jurisdiction: str) -> DataFrame:
    """(country, name) of active entities of a jurisdiction in a register's CSV: no funds, branches or sole proprietors, the first of equal names."""
    from gleaner.operators.dedup import keep_first

    rows = spark.read.option("header", True).csv(path)
    name = lambda c: F.col(f"`{c}`")
    of = name("Entity.LegalJurisdiction")
    kept = rows.where((name("Entity.EntityStatus") == "ACTIVE") & ((of == jurisdiction) | of.startswith(f"{jurisdiction}-")))
    kept = kept.where(~F.coalesce(name("Entity.EntityCategory").isin("FUND", "BRANCH", "SOLE_PROPRIETOR"), F.lit(False)))
    listed = kept.select(F.lit(jurisdiction).alias("country"), F.trim(name("Entity.LegalName")).alias("name"), F.monotonically_increasing_id().alias("line_no"))
    listed = listed.where((F.octet_length("name") >= 3) & ~F.lower("name").rlike(r"\blei\b"))
    return keep_first(listed, F.concat_ws("\u0001", "country", F.lower("name")), ["line_no"]).drop("line_no")


def legal_forms(spark: SparkSession, path: str) -> DataFrame:
    """(code, forms): abbreviations of each legal form in file order, a row's local ones before its transliterated ones, each once."""
    rows = spark.read.option("header", True).csv(path).withColumn("line_no", F.monotonically_increasing_id())
    split = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x))
    both = F.concat(split("Abbreviations Local language"), split("Abbreviations transliterated"))
    flat = rows.select(F.col("ELF Code").alias("code"), "line_no", F.posexplode(both).alias("pos", "form")).where("form <> ''")
    first = flat.groupBy("code", "form").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    return first.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("at", "form"))).alias("all")).select("code", F.transform("all", lambda x: x["form"]).alias("forms"))


def verify_digest(spark: SparkSession, path: str, expected: str) -> None:
    """Raises unless a file's sha256 is the expected one; files are hashed where they are read."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest")).collect()
    if [r["digest"] for r in found] != [expected.removeprefix("sha256-").lower()]:
        raise ContractError(f"{path} is not what its manifest says")
