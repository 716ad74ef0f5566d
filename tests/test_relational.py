import gzip
import itertools
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashing, html, offsets, text, urls
from gleaner.operators import augment, corpus, dedup, joins, leakage, metrics, neural, policy, rules, splits
from gleaner.plans import api, requests
from gleaner.sources import readers, writers
from gleaner.streaming import detect as streams


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fnv_natively_and_in_python(spark):
    texts = ["", "a", "^H", "é漢$", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for seed in (0, 0x9E37):
        got = rows.select("t", hashing.hex_digits(hashing.fnv1a_halves(F.col("t"), seed)).alias("h"), hashing.modulo(hashing.fnv1a_halves(F.col("t"), seed), 12).alias("m")).collect()
        for r in got[:-1]:
            assert int(r["h"], 16) == hashing.fnv1a(r["t"].encode(), seed) and r["m"] == hashing.fnv1a(r["t"].encode(), seed) % 12
        assert got[-1]["m"] is None
    assert hashing.fnv1a(b"^H") % 32768 == 14859


def test_offsets(spark):
    rows = spark.createDataFrame([("é 12 📞 34",)], "t string")
    m = rows.select(offsets.matches(F.col("t"), "[0-9]+").alias("m")).first()["m"]
    assert [(x["start"], x["end"], x["text"]) for x in m] == [(3, 5, "12"), (11, 13, "34")]
    cut = rows.select(offsets.byte_slice(F.col("t"), F.lit(3), F.lit(5)), offsets.utf16_offset(F.col("t"), F.lit(11))).first()
    assert tuple(cut) == ("12", 8)
    assert offsets.utf16_offsets("é 12 📞 34", [3, 11]) == [2, 8]


def test_lines_words_and_shingles(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\x85d e\n",), ("",), ("Straße x_1 ÉTÉ",)], "t string")
    assert [r[0] for r in rows.select(text.lines(F.col("t"))).collect()][:2] == [["a", "b", "c", "d", "e"], []]
    assert rows.select(text.words(F.col("t"))).collect()[2][0] == ["strasse", "x_1", "été"]
    n = spark.createDataFrame([(list("abcabc"),), (list("ab"),)], "w array<string>").select(F.size(text.shingles(F.col("w"), 3))).collect()
    assert [r[0] for r in n] == [3, 0]
    assert text.person_key("Müller, Ána Jr") == ("ana", "muller") and text.person_key("Dr John Smith III") == ("dr", "smith") and text.person_key("X") is None
    assert text.normalise_surface("  The  ÀB ", True) == "àb"


def test_urls(spark):
    rows = spark.createDataFrame([("HTTP://www.Example.com:80/a/?q=1#f",), ("https://x.org:8443//",), ("no url",), (None,)], "url string")
    assert [r[0] for r in rows.select(urls.url_key(F.col("url"))).collect()] == ["https://example.com/a?q=1", "https://x.org:8443", None, None]
    fr = spark.createDataFrame([("https://www.federalregister.gov/documents/2024/x/2024-12345/y", None, "g"), ("https://a.b/c/", "n 2023-00001", "g"), ("https://A.b/c/?q", None, None), (None, None, "g")], "u string, id string, g string")
    assert [r[0] for r in fr.select(urls.document_key(F.col("u"), F.col("id"), group=F.col("g"))).collect()] == ["fr:2024-12345", "fr:2023-00001", "url:https://a.b/c", "group:g"]


def test_notices(spark):
    hidden = bytes([7, *(b ^ 7 for b in b"a@b.com")]).hex()
    page = f'<p>ADDRESSES: Write\nto a long-\nname at <a href="#" data-cfemail="{hidden}">[email]</a> Mu[ntilde]oz [sic].\n\n\nOTHER HEADING: no</p>'
    assert html.notice_text(page) == "ADDRESSES: Write to a long-name at a@b.com Muñoz [sic].\n\nOTHER HEADING: no"
    got = spark.createDataFrame([(page,)], "h string").select(html.notice_texts(F.col("h")).alias("t")).select(html.sections(F.col("t"))).first()[0]
    assert got == "ADDRESSES:\nWrite to a long-name at a@b.com Muñoz [sic]."


def test_keep_first_and_conflicts(spark):
    rows = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3), (4, None, 1), (5, None, 1)], "id long, t string, x int")
    assert values(dedup.keep_first(rows, F.col("t"), ["id"]).select("id")) == [(1,), (2,), (4,), (5,)]
    assert dedup.conflicting(rows, F.col("t"), F.col("x")).count() == 1


def test_containment_equals_brute_force(spark):
    import random

    rnd, docs = random.Random(1), []
    for i in range(40):
        base = [f"w{rnd.randrange(300)}" for _ in range(60)]
        for _ in range(rnd.choice([1, 2, 3])):
            docs.append((len(docs), " ".join(["common line that everybody has on top of it"] + base[: rnd.choice([60, 60, 50, 30])])))
    docs += [(len(docs), docs[0][1]), (len(docs) + 1, None), (len(docs) + 2, "short")]
    sets = {i: {tuple(w[k : k + 7]) for k in range(len(w) - 6)} for i, t in docs for w in [(t or "").split()]}
    close = lambda a, b: len(a) >= 5 and len(b) >= 5 and len(a & b) >= 0.8 * min(len(a), len(b)) - 1e-9
    want = {j: min(i for i in sets if i < j and close(sets[i], sets[j])) for j in sets if any(i < j and close(sets[i], sets[j]) for i in sets)}
    got = dedup.near_duplicates(spark.createDataFrame(docs, "id long, t string"), "id", text.words(F.col("t"))).collect()
    assert {r["id"]: r["prior"] for r in got} == want


def test_leakage(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "Nothing here"), (3, None)], "doc_id long, text string")
    gold = spark.createDataFrame([(7, "x " + " ".join(words[5:20]).upper()), (8, " ".join(words[:11]))], "item_id long, text string")
    assert values(leakage.prose_overlap(docs, gold, "doc_id", "item_id")) == [(1, [7])]
    a, b = (spark.createDataFrame(rows, "id long, k string") for rows in ([(1, "x"), (2, "y"), (3, None)], [(9, "x"), (8, "x"), (7, None)]))
    assert values(leakage.collisions(a, b, ["k"], "id", "id")) == [(1, "x", [8, 9])]
    assert values(leakage.without(a, b.where("k is not null"), ["k"])) == [(2, "y"), (3, None)]
    with pytest.raises(ValueError):
        leakage.disjoint_or_fail(a, b, ["k"], "keys")
    family = spark.createDataFrame([("f", "x"), ("f", "z"), ("g", "q")], "family string, alias string")
    assert values(leakage.families(family, spark.createDataFrame([("x",)], "alias string"))) == [("f", "x"), ("f", "z")]


def test_quotas_and_samples(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 2 == 0) for i in range(300)], "id long, g string, place boolean")
    kept = values(splits.quotas(rows, ["g"], ["id"], 20, F.col("place")).select("g", "id", "place"))
    for g in "ab":
        mine = sorted((i, p) for x, i, p in kept if x == g)
        every = [(i, i % 2 == 0) for i in range(300) if ("a" if i % 3 else "b") == g]
        places = [r for r in every if r[1]][:3]
        assert mine == sorted([r for r in every if not r[1]] + places)[:20]
    assert values(splits.uncovered(rows, ["g"], 150)) == [("b", 100)]
    assert splits.equal_shares(rows, "g", "id", 30).groupBy("g").count().select("count").distinct().collect()[0][0] == 15
    assert splits.equal_shares(rows, "g", "id", 260).count() == 260
    once = splits.mixed_passes(rows, "g", "id").orderBy("turn").select("g").limit(20).collect()
    assert abs(sum(r[0] == "a" for r in once) - 10) == 0
    capped = splits.capped_selection(rows, "g", "id", {"place": 4}, 6).groupBy("g", "place").count().collect()
    assert all(r["count"] <= 4 for r in capped) and sum(r["count"] for r in capped) == 12
    views = spark.createDataFrame([("p", 0, "v0"), ("p", 1, "v1")], "parent string, view_no int, view string")
    shown = spark.createDataFrame([("p", i) for i in range(6)], "parent string, n int")
    assert [r["view"] for r in splits.rotating_views(shown, views, "parent", "n").orderBy("n").collect()] == [None, "v0", None, "v1", None, "v0"]


GOLD, PRED = "doc long, kind string, start int, end int", "doc long, kind string, start int, end int"


def test_scores(spark):
    gold = spark.createDataFrame([(1, "org", 0, 5), (1, "org", 0, 5), (1, "person", 8, 12), (2, "org", 0, 3)], GOLD)
    pred = spark.createDataFrame([(1, "org", 0, 5), (1, "org", 0, 5), (1, "org", 0, 5), (1, "person", 9, 12), (1, "org", 8, 12), (3, "org", 1, 2)], PRED)
    found = {r["kind"]: (r["gold"], r["predicted"], r["tp"], r["precision"], r["recall"]) for r in metrics.exact_score(gold, pred, ["kind"], ["doc", "kind", "start", "end"]).collect()}
    assert found["org"] == (3, 5, 2, 0.4, 0.6667) and found["person"] == (1, 1, 0, 0.0, 0.0) and found[None] == (4, 6, 2, 0.3333, 0.5)
    errors = sorted(r["error"] for r in metrics.error_classes(gold, pred, "doc").collect())
    assert errors == ["boundary", "duplicate", "exact", "exact", "no_overlap", "wrong_kind"]
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc long")
    assert values(metrics.false_positive_rate(gold, pred, docs, "doc")) == [("org", 2, 0.5)]
    assert {r["kind"]: r["matched"] for r in metrics.one_to_one(gold, pred, "doc").where("doc = 1").collect()} == {"org": 2, "person": 1}


@pytest.mark.parametrize("least_iou", [0.0, 0.4])
def test_one_to_one_by_clusters_equals_matching_by_documents(spark, least_iou):
    import random

    rnd, sides = random.Random(7), []
    for _ in range(2):
        spans = [(rnd.randint(1, 12), rnd.choice(["org", "person", None]), a, a + rnd.randint(0, 9)) for a in (rnd.randint(0, 120) for _ in range(300))]
        sides.append([*spans, (99, "org", 5, 5), (98, "org", 0, 9), (98, "org", 4, 4), (98, "org", 5, 8)])
    want = {}
    for key in {s[:2] for side in sides for s in side}:
        own = [[list(s[2:]) for s in side if s[:2] == key] for side in sides]
        want[key] = len(metrics.matching(metrics.overlapping(own[1], own[0], least_iou)))
    found = metrics.one_to_one(*(spark.createDataFrame(s, GOLD) for s in sides), "doc", least_iou)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups go on in other batches
    rows = found.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["doc"], r["kind"]): r["matched"] for r in rows} == want and len(rows) == len(want)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()  # documents by the million are no Python calls


def test_near_duplicates_write_no_sets_and_equal_brute_force(spark, monkeypatch):
    import random

    rnd, names, plain = random.Random(4), [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: names.append((name, df.columns)) or plain(df, name))
    base = [[str(rnd.randint(0, 400)) for _ in range(30)] for _ in range(12)]
    docs = []
    for i in range(80):
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            own[rnd.randrange(30)] = "new"
        docs.append((i, " ".join(own[: rnd.choice([30, 30, 20])])))
    sets = {i: {tuple(w[k : k + 7]) for k in range(len(w) - 6)} for i, w in ((i, t.split()) for i, t in docs)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b])) - 1e-9
    want = {(b, min(a for a in range(b) if near(a, b))) for b in sets if any(near(a, b) for a in range(b))}
    found = dedup.near_duplicates(spark.createDataFrame(docs, "id long, t string"), "id", text.words(F.col("t")))
    assert {tuple(r) for r in found.collect()} == want
    assert all("s" not in columns for _, columns in names)


def test_matching_is_largest_by_brute_force():
    import random

    rnd = random.Random(3)
    for _ in range(60):
        pairs = [(a, b) for a in range(5) for b in range(5) if rnd.random() < 0.3]
        best = max((len(s) for n in range(6) for s in itertools.combinations(pairs, n) if len({a for a, _ in s}) == len({b for _, b in s}) == n), default=0)
        found = metrics.matching(pairs)
        assert len(found) == best and all((a, b) in pairs for b, a in found.items()) and len(set(found.values())) == len(found)


def test_other_aggregates(spark):
    r = spark.createDataFrame([("s", float(v)) for v in (4, 1, 3, 2)], "stage string, ms double")
    assert values(metrics.stage_timings(r, "stage", "ms")) == [("s", 4, 3.0, 4.0)]
    c = metrics.calibration(spark.createDataFrame([(1.0, 1), (0.95, 0), (0.05, 0)], "c double, y int"), "c", "y").collect()
    assert {x["bin"]: x["n"] for x in c} == {9: 2, 0: 1} and c[0]["ece"] == pytest.approx((2 * 0.475 + 0.05) / 3)
    v = spark.createDataFrame([("k", x) for x in ["correct"] * 9 + ["wrong", "missing"]], "kind string, verdict string")
    assert metrics.review_score(v).first()["accept"]
    assert values(metrics.class_weights(spark.createDataFrame([("O", 100), ("B", 1), ("I", 25)], "l string, n long"), "l", "n")) == [("B", 5.0), ("I", 2.0), ("O", 1.0)]
    g = spark.createDataFrame([(1, "k", 0.1), (2, "k", 0.9), (3, "k", 0.95)], "step int, kind string, r double")
    assert values(metrics.learning_gate(g, "step", "kind", "r", 2, 0.9)) == [("k", True)]
    cases, preds = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", [1])], "name string, e array<int>")
    assert values(metrics.align(cases, preds, "name", "e")) == [("a", [1]), ("b", [])]
    with pytest.raises(ValueError):
        metrics.align(cases, spark.createDataFrame([("z", [1])], "name string, e array<int>"), "name", "e")
    own = "doc long, kind string, start int, end int, owner int"
    a = metrics.assignments(spark.createDataFrame([(1, "email", 5, 9, 0), (1, "phone", 10, 12, 0), (1, "email", 20, 22, None)], own), spark.createDataFrame([(1, "email", 5, 9, 0), (1, "email", 20, 22, 3)], own), "doc").first()
    assert (a["correct"], a["wrong"], a["missed"]) == (1, 1, 1)
    cards = "doc long, members array<string>, confidence double"
    x = metrics.exact_cards(spark.createDataFrame([(1, ["a"], 1.0)], cards), spark.createDataFrame([(1, ["a"], 0.95), (1, ["b"], 0.5)], cards), "doc").first()
    assert tuple(x) == (1, 2, 1, 1, 1)


def test_policy(spark):
    rows = spark.createDataFrame([("org", "model", 0.85), ("org", "model", 0.79), ("email", "rules", 0.7), ("email", "rules", 0.4)], "kind string, source string, confidence float")
    assert [r["confidence"] > 0.8 for r in policy.detector_thresholds(rows).where("source = 'model'").collect()] == [True]
    assert sorted((round(r["confidence"], 2), r["review_recommended"]) for r in policy.bands(rows).collect()) == [(0.7, True), (0.79, True), (0.85, False)]
    assert policy.bands(rows, True).count() == 4
    parts = spark.createDataFrame([(1, "suburb", 0, 3, 0.9, "栄"), (1, "suburb", 3, 9, 0.8, "3丁目"), (1, "city", 10, 14, 0.9, " , x"), (1, "city", 20, 22, 0.95, "yz"), (1, "road", 30, 32, 0.2, ",;")], "a long, label string, start int, end int, confidence float, text string")
    assert sorted((r["start"], r["end"]) for r in policy.merge_suburbs(parts, ["a"]).where("label = 'suburb'").collect()) == [(0, 9)]
    assert sorted((r["start"], r["text"]) for r in policy.trim_components(parts).where("label = 'city'").collect()) == [(13, "x"), (20, "yz")]
    assert values(policy.unknown_components(parts, ["a"]).groupBy("label").count()) == [("city", 1), ("suburb", 2), ("unknown", 1)]
    assert policy.address_confidence(parts, ["a"]).first()["confidence"] == pytest.approx(0.2)


TEXT = "Nino Beridze\nACME Ltd\n14 Oak Street, Denver, CO 80202\nnino@acme.com\n+1 202-555-0143\n"


def test_api(spark):
    docs = spark.createDataFrame([(1, TEXT, 5), (2, None, 5), (3, "", 5), (4, "no details", 5)], "doc_id long, text string, kind int")
    found = api.detect(docs, ["doc_id"]).collect()
    assert {r["kind"] for r in found} == {"person", "org", "address", "email", "phone"} and {r["doc_id"] for r in found} == {1}
    assert all(TEXT.encode()[r["start"] : r["end"]].decode() == r["text"] for r in found)
    assert {c["label"] for r in found if r["kind"] == "address" for c in r["components"]} >= {"house_number", "road", "city", "region", "postcode"}
    assert {r["kind"] for r in api.detect(docs, ["doc_id"], api.Options(kinds=("phone",))).collect()} == {"phone"}
    out = api.extract_contacts(docs, ["doc_id"])
    c = out.where("doc_id = 1").first()["contacts"]
    assert len(c) == 1 and c[0]["person"]["text"] == "Nino Beridze" and c[0]["org"]["text"] == "ACME Ltd" and len(c[0]["emails"]) == len(c[0]["phones"]) == len(c[0]["addresses"]) == 1
    assert api.contact_members(out, ["doc_id"]).count() == 5
    shown = json.loads(writers.extraction_json(out.join(docs.select("doc_id", "text"), "doc_id"), ["doc_id"], "text", True).where("doc_id = 1").first()["json"])
    assert "components" not in shown["contacts"][0]["emails"][0] and shown["contacts"][0]["person"]["confidence"] == 0.9 and shown["unassigned"] == []
    entity = json.loads(writers.detection_json(rules.with_rules(docs, ["doc_id"]), ["doc_id"]).where("doc_id = 1").first()["json"])
    assert [e["kind"] for e in entity["entities"]] == ["email", "phone"]
    parsed = api.parse_address(spark.createDataFrame([(1, "14 Oak Street, Denver, CO 80202"), (2, None), (3, "x " * 5000)], "id long, text string"), ["id"]).orderBy("id").collect()
    assert parsed[0]["confidence"] > 0 and parsed[1]["components"] == [] and parsed[2]["error"]
    md = api.detect(spark.createDataFrame([(1, "`x@y.com` [a](mailto:b@c.com)")], "doc_id long, text string"), ["doc_id"], api.Options(kinds=("email",), markdown=api.markdown.Options()))
    assert [r["normalized"] for r in md.collect()] == ["b@c.com"]
    with pytest.raises(ValueError):
        api.Options(kinds=("nothing",))
    with pytest.raises(ValueError):
        api.Options(country_hint=("USA",))
    api.register(spark)
    assert spark.sql("SELECT find_emails('x a@b.com')[0].normalized").first()[0] == "a@b.com"
    assert spark.sql("SELECT find_phones('(202) 555-0199', array('US'))[0].normalized").first()[0] == "+12025550199"


LINES = [
    "en\tus\t123/house_number Main/road Street/road ,/SEP Springfield/city ,/SEP IL/state 62701/postcode\r",
    "en\tus\t123/house_number Main/road St/road |/FSEP Springfield/city IL/state 62701/postcode",
    "en\tus\tSpringfield/city IL/state", "en\tus\tfood/category in/near Springfield/city", "en\tus\tKew/road Foot/road Roa/road", "en\tus\t1/house_number Oak/road Lane/road 123/postcode",
    "ja\tjp\t静/city 岡/city 市/city １/house_number 丁/house_number 目/house_number", "broken", "de\tde\t5/house_number Hauptstr./road ,/SEP D-10115/postcode Berlin/city",
]


def test_corpus(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt", newline="") as f:
        f.write("\n".join(LINES) + "\n")
    lines = readers.tagged_lines(spark, str(tmp_path / "a.tsv.gz"))
    found = corpus.examples(lines, ["line_no"]).orderBy("line_no").collect()
    assert [r["reason"] for r in found] == [None, None, None, "excluded", "truncated_road", "foreign_postcode", None, "malformed", None]
    assert found[0]["group_key"] == found[1]["group_key"] and found[1]["text"] == "123 Main St\nSpringfield IL 62701" and found[6]["text"] == "静岡市１丁目"
    assert found[8]["text"] == "5 Hauptstr., D-10115 Berlin"
    for r in found:
        if not r["reason"]:
            spans = [(s["label"], s["start"], s["end"]) for s in r["spans"]]
            assert corpus.spans_valid(r["text"], spans) and corpus.render(corpus.decompose(r["text"], spans)) == (r["text"], spans)
    assert corpus.examples(lines, ["line_no"], countries=["DE"]).count() == 1
    kept = corpus.prepare(corpus.examples(lines, ["line_no"]), "line_no", 10)
    assert kept.count() == 5
    rows = kept.withColumns({"id": F.col("line_no"), "augmented": F.lit(False), "original": F.lit(None).cast("long")})
    assert tuple(corpus.checks(rows).first()) == (0, 0, 0, 0)
    writers.address_shards(rows.select("id", "country", "text", "spans", "split"), str(tmp_path / "shards"))
    again = readers.address_shard(spark, str(tmp_path / "shards"))
    assert values(again.select("id", "text", "spans")) == values(rows.select("id", "text", "spans"))
    with pytest.raises(Exception):
        writers.address_shards(rows.select("id", "country", "text", "spans", "split"), str(tmp_path / "shards"))
    copies = augment.augmented(rows.where("country = 'US'"), "id", 5, 3).collect()
    assert copies and len({(r["id"], r["text"]) for r in copies}) == len(copies)
    assert augment.original_id(augment.copy_id(7, 5, 3), 5) == 7


def test_names():
    assert corpus.names_a_person("MRS JANE DOE DISCRETIONARY TRUST") and not corpus.names_a_person("The Smith Settlement")
    assert corpus.address_like("2100 POWELL STREET MEZZ, LLC") and not corpus.address_like("3M Company")
    assert corpus.without_disambiguator("Asahi (Japan)") == "Asahi" and corpus.without_disambiguator("ACME (NATO)") == "ACME (NATO)"
    assert corpus.without_article("The Big Firm") == "Big Firm"


def test_readers(spark, tmp_path):
    def put(name, *rows):
        path = tmp_path / name
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return str(path)

    case = {"name": "a", "input": "é x@y.com", "expected": [{"kind": "email", "start": 3, "end": 10, "text": "x@y.com"}], "country": "US", "doc_type": "t"}
    got = readers.gold(spark, put("gold", case, case | {"name": "b", "expected": []})).orderBy("name").collect()
    assert got[0]["slices"] == {"country": "US", "doc_type": "t"}
    for bad in (case | {"expected": [{"kind": "email", "start": 1, "end": 3}]}, case | {"expected": [{"kind": "email", "start": 3, "end": 9, "text": "x@y.com"}]}, case | {"expected": case["expected"] * 2}):
        with pytest.raises(readers.ContractError):
            readers.gold(spark, put("bad", bad))
    with pytest.raises(readers.ContractError):
        readers.gold(spark, put("twice", case, case))
    doc = {"id": "1", "text": "t", "country": "US", "entities": [{"kind": "org", "start": 0, "end": 1}]}
    assert readers.silver(spark, put("silver", doc, doc)).count() == 1
    with pytest.raises(readers.ContractError):
        readers.silver(spark, put("conflict", doc, doc | {"entities": []}))
    request = {"operation": "detect", "text": "x", "kinds": ["email"], "country_hint": ["us"]}
    assert readers.requests(spark, put("req", request)).count() == 1
    for bad in ({**request, "extra": 1}, {**request, "operation": "drop"}, {**request, "kinds": ["cat"]}, {**request, "country_hint": ["usa"]}):
        with pytest.raises(readers.ContractError):
            readers.requests(spark, put("badreq", bad))


def test_external_spans_and_registers(spark, tmp_path):
    rows = spark.createDataFrame([("é Ana", [("PER", 2, 5), ("MISC", 0, 1)])], "text string, entities array<struct<kind:string,start:int,end:int>>")
    assert [tuple(e) for e in readers.external(rows, {"PER": "person"}).first()["entities"]] == [("person", 3, 6)]
    head = "Entity.LegalName,Entity.EntityStatus,Entity.LegalJurisdiction,Entity.EntityCategory"
    (tmp_path / "r.csv").write_text("\n".join([head, "ACME Ltd,ACTIVE,US-DE,", "Acme LTD,ACTIVE,US,GENERAL", "Gone,INACTIVE,US,", "A Fund,ACTIVE,US,FUND", "Other,ACTIVE,GB,", "The LEI,ACTIVE,US,"]))
    assert values(readers.organizations(spark, str(tmp_path / "r.csv"), "US")) == [("US", "ACME Ltd")]
    (tmp_path / "f.csv").write_text("ELF Code,Abbreviations Local language,Abbreviations transliterated\nX1,Ltd;Ltd.,ltd\nX1,,Ltd;L.\nX2,,\n")
    assert values(readers.legal_forms(spark, str(tmp_path / "f.csv"))) == [("X1", ["Ltd", "Ltd.", "ltd", "L."])]


def test_british_source_rules():
    p = corpus.pieces_of("en", "gb", [("1", "house_number"), ("Elm", "road"), ("Road", "road"), ("Leeds", "city"), ("West", "state_district"), ("Midlands", "state_district"), ("UK", "country"), ("LS1", "postcode")])
    assert corpus.render(corpus.normalise_source("GB", p))[0] == "1 Elm Road Leeds LS1\nUK"


def test_japanese_source_rules():
    def written(*pairs):
        return corpus.render(corpus.normalise_source("JP", corpus.Pieces([corpus.Piece(k, t) for k, t in pairs], [" "] * (len(pairs) - 1))))

    text, spans = written(("house_number", "5-1"), ("suburb", "３丁目"), ("road", "栄"), ("city", "名古屋市中区"), ("region", "愛知"), ("postcode", "460-0008"), ("country", "日本"))
    assert text == "日本 460-0008 愛知県名古屋市中区栄３丁目5-1"
    assert [k for k, _, _ in spans] == ["country", "postcode", "region", "city", "district", "suburb", "house_number"]
    assert written(("road", "銀座4"), ("suburb", "銀座"), ("city", "中央区"), ("region", "東京都"))[0] == "東京都中央区銀座4"
    assert written(("city", "東京都調布市"), ("region", "関東地方"), ("house_number", "7"))[0] == "東京都調布市7"
    assert sorted(k for k, _, _ in written(("city", "中川郡池田町"))[1]) == ["city", "district"]
    assert written(("house_number", "1"), ("road", "職安通り"), ("city", "新宿区"), ("region", "東京都"))[0] == "東京都新宿区職安通り1"
    assert written(("house_number", "2-1"), ("road", "Maruyama-cho"), ("city", "Kyoto"))[1][1][0] == "suburb"
    for bad, reason in (([("country", "にほん")], "kana_reading"), ([("house_number", "東京1")], "mislabelled"), ([("city", "横浜市戸塚")], "mislabelled")):
        with pytest.raises(corpus.Rejected, match=reason):
            written(*bad)


def test_stream_gives_the_rows_of_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "a@b.com")], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.read_documents(spark, str(tmp_path / "in"))
    streams.write_entities(streams.entities(stream, ["doc_id"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    columns = ["doc_id", "kind", "start", "end"]
    assert values(spark.read.parquet(str(tmp_path / "out")).select(*columns)) == values(api.detect(docs, ["doc_id"]).select(*columns))


def test_near_within_is_greedy_by_brute_force(spark):
    import random

    rnd, docs = random.Random(4), []
    for _ in range(8):
        now = [f"w{rnd.randrange(400)}" for _ in range(50)]
        for _ in range(6):  # a chain: each is near to the next, the ends aren't
            now = [w if rnd.random() > 0.012 else f"x{rnd.randrange(400)}" for w in now]
            docs.append((len(docs), " ".join(now), rnd.choice("ab")))
    sets = {i: ({tuple(w[k : k + 7]) for k in range(len(w) - 6)}, g) for i, t, g in docs for w in [t.split()]}
    kept, want = [], {}
    for i, (own, g) in sets.items():
        prior = next((k for k in kept if sets[k][1] == g and len(own & sets[k][0]) >= 0.8 * min(len(own), len(sets[k][0])) - 1e-9), None)
        if prior is None:
            kept.append(i)
        else:
            want[i] = prior
    rows = spark.createDataFrame(docs, "id long, t string, g string")
    found = dedup.near_within(rows, "id", text.words(F.col("t")), F.col("g"))
    assert want and {r["id"]: r["prior"] for r in found.collect()} == want
    assert dedup.near_within(rows.limit(0), "id", text.words(F.col("t")), F.col("g")).count() == 0


def test_overlaps_by_a_sweep_equal_all_pairs():
    import random

    rnd = random.Random(9)
    for _ in range(80):
        a, b = ([[s, s + rnd.randrange(0, 9)] for s in (rnd.randrange(20) for _ in range(rnd.randrange(9)))] for _ in "ab")
        for iou in (0.0, 0.5):
            want = [(i, j) for i, (s, e) in enumerate(a) for j, (x, y) in enumerate(b) if min(e, y) > max(s, x) and min(e, y) - max(s, x) >= iou * (max(e, y) - min(s, x))]
            assert metrics.overlapping(a, b, iou) == want


def test_ordered_and_prefix_joins_at_edges(spark):
    rows = spark.createDataFrame([(1, 10), (1, None), (2, 5), (None, 7), (1, 3)], "k int, at int")
    marks = spark.createDataFrame([(1, 10, 5), (1, 10, 7), (1, 4, 1), (None, 6, 9), (2, None, 3)], "k int, m int, v int")
    assert values(joins.as_of(rows, marks, ["k"], "at", "m", "v")) == sorted([(1, 10, 7), (1, None, None), (2, 5, None), (None, 7, 9), (1, 3, None)], key=str)
    assert values(joins.nearest(rows, marks, ["k"], "at", "m", 2).select("k", "at", "mark")) == sorted([(1, 10, 10), (1, None, None), (2, 5, None), (None, 7, 6), (1, 3, 4)], key=str)
    numbers = spark.createDataFrame([("4512",), ("45",), ("",), (None,), ("7",), ("45",)], "n string")
    plan = spark.createDataFrame([("4x1", "a"), ("4", "b"), ("45", "c"), ("4x", "d"), ("", "e")], "prefix string, region string")
    assert values(joins.prefix_join(numbers, plan, "n", "prefix")) == sorted([("4512", "4x1", "a"), ("45", "45", "c"), ("45", "45", "c")], key=str)


def test_parse_scores_count_characters_and_multisets(spark):
    span = "array<struct<label:string,start:int,end:int>>"
    rows = [("US", "5 Öl St", [("house_number", 0, 1), ("road", 2, 8)], [("road", 2, 8), ("house_number", 0, 1)]), ("US", "ab", [("road", 0, 2)], [("road", 0, 1)]), ("DE", None, None, None), ("DE", "x", [("road", 0, 1)] * 2, [("road", 0, 1)])]
    found = {r["country"]: (r["rows"], r["exact"], r["characters"], r["correct"]) for r in metrics.parse_scores(spark.createDataFrame(rows, f"country string, text string, gold {span}, predicted {span}")).collect()}
    assert found == {"US": (2, 1, 7, 6), "DE": (2, 1, 1, 1), None: (4, 2, 8, 7)}


def test_answers_to_requests(spark, tmp_path):
    asked = [
        {"operation": "detect", "text": "é a@b.com", "offsets": "utf16"}, {"operation": "detect", "text": "é a@b.com", "kinds": ["email"]}, {"operation": "contacts", "text": TEXT},
        {"operation": "address", "text": "14 Oak Street, Denver, CO 80202"}, {"operation": "address", "text": ""}, {"operation": "address", "text": "x " * 5000}, {"operation": "detect", "text": "`a@b.com`", "format": "markdown"},
        {"operation": "detect", "text": "call (202) 555-0143 now", "country_hint": ["us"]},
    ]
    path = tmp_path / "requests"
    path.write_text("\n".join(json.dumps(r) for r in asked))
    rows = readers.requests(spark, str(path)).coalesce(1).withColumn("id", F.monotonically_increasing_id())
    got = [(json.loads(r["json"]) if r["json"] else None, r["error"]) for r in requests.answers(rows, ["id"]).orderBy("id").collect()]
    assert [e["start"] for e in got[0][0]["entities"]] == [2] and [e["start"] for e in got[1][0]["entities"]] == [3]
    assert set(got[2][0]) == {"model", "operation", "contacts", "unassigned"} and len(got[2][0]["contacts"]) == 1
    assert {c["label"] for c in got[3][0]["address"]["components"]} >= {"road", "city"} and got[3][0]["address"]["start"] == 0
    assert got[4][0]["address"]["components"] == [] and got[5] == (None, "too long for an address")
    assert got[6][0]["entities"] == [] and got[7][0]["entities"][0]["normalized"] == "+12025550143"
    for bad in ({"operation": "address", "text": "x", "kinds": ["email"]}, {"operation": "detect", "text": "x", "format": "pdf"}, {"operation": "detect", "text": "x", "offsets": "bytes"}, {"operation": "detect"}):
        path.write_text(json.dumps(bad))
        with pytest.raises(readers.ContractError):
            readers.requests(spark, str(path))


def test_same_places_and_reports(spark, tmp_path):
    span = "array<struct<label:string,start:int,end:int>>"
    city, house = [("city", 0, 4)], [("house_number", 5, 6)]
    rows = [(1, "JP", "Noda", city), (2, "JP", "Noda", city), (3, "JP", "Noda 5", city + house), (4, "JP", "Noda 5", city + house), (5, "DE", "Noda", city), (6, "JP", "Noda (station)", city)]
    made = spark.createDataFrame(rows, f"n long, country string, text string, spans {span}")
    assert sorted(r["n"] for r in dedup.same_place(made, ["n"]).collect()) == [1, 3, 4, 5]
    writers.report(made.select("n"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 6 and len(list((tmp_path / "report").glob("part-*"))) == 1


def test_model_directories(tmp_path):
    import hashlib

    import numpy as np

    header = json.dumps({"__metadata__": {"net": "x"}, "t": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    data = len(header).to_bytes(8, "little") + header + np.array([1, 2], "<f4").tobytes()
    (tmp_path / "w.safetensors").write_bytes(data)
    good = {"runtime": "r", "file": "w.safetensors", "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "metadata": {"detector_input_policy": "known_us"}}

    def read(**changed):
        (tmp_path / "bundle.json").write_text(json.dumps(good | changed))
        return neural.read_model(str(tmp_path), "r")

    model = read()
    assert model.country_hint == ("US",) and model.tensors["t"].tolist() == [1, 2] and model.metadata["net"] == "x"
    assert read(metadata={}).country_hint == () and read(bytes=None)
    for bad in ({"runtime": "q"}, {"sha256": "12"}, {"sha256": "0" * 64}, {"file": "../w.safetensors"}, {"file": ".."}, {"file": "none"}, {"bytes": 3}):
        with pytest.raises(neural.BundleError):
            read(**bad)
