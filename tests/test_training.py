import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.operators import generate, leakage, tokens, training
from gleaner.operators.augment import Draw
from gleaner.sources import readers

SPAN = "array<struct<kind:string,start:int,end:int>>"


def span(text, kind, part):
    at = text.encode().index(part.encode())
    return (kind, at, at + len(part.encode()))


def test_address_keys():
    assert keys.address_keys("5 Oak Street\nDenver, CO 80202-1234") == {("80202", "5", "oak")}
    assert keys.address_keys("Write to 12B North Main St, Suite 4, Denver, CO 80202. 99 Elm Road, Salem, OR 97301") == {("80202", "12", "main"), ("97301", "99", "elm")}
    assert keys.address_keys("5 Oak Street" + " x" * 120 + " 80202") == set() and keys.address_keys("no zip 5 Oak Street") == set()
    assert keys.address_keys("at 300 7th Street, SW, Washington, DC 20590", prose=True) == {("20590", "300", "7")}


def test_physical_key(spark):
    text = "12B North Oak St, Denver 80202"
    spans = [("house_number", 0, 3), ("road", 4, 16), ("postcode", 25, 30)]
    rows = spark.createDataFrame([("US", text, spans), ("GB", text, spans), ("US", text, spans[:2])], "country string, text string, spans array<struct<label:string,start:int,end:int>>")
    assert [r[0] and tuple(r[0]) for r in rows.select(keys.physical_key(F.col("country"), F.col("text"), F.col("spans"))).collect()] == [("80202", "12", "oak"), None, None]


def test_pieces_and_reasons(spark):
    text = "Ana Lee is é here.\n\nBob\n\nRoe works. Mail a@b.com now.\n\n" + "word " * 30
    gold = [span(text, "person", "Ana Lee"), span(text, "person", "Bob\n\nRoe"), span(text, "org", "b.com"), span(text, "org", "or")]
    cut = training.pieces(text, gold, 12)
    assert cut[0][0] == 0 and cut[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert not any(s < edge < e for _, s, e in gold for edge, _ in cut)
    assert training.unreachable(text, gold)[0] == [] and "blank_line" in training.unreachable(text, gold)[1] and "rule_overlap" in training.unreachable(text, gold)[2] and "token_boundary" in training.unreachable(text, gold)[3]
    rows = training.document_pieces(spark.createDataFrame([(1, text, gold), (2, None, None)], f"id long, text string, entities {SPAN}"), ["id"], 12).orderBy("piece_no").collect()
    assert [r["start"] for r in rows] == [a for a, _ in cut] and sum(len(r["spans"]) for r in rows) == len(gold)


def test_closure_is_a_fixed_point():
    gold = [(10, 12), (20, 22), (40, 41)]
    assert training.closure((10, 12), gold, 100, 5) == (5, 17)
    assert training.closure((10, 12), gold, 100, 9) == (1, 31)
    assert training.closure((10, 12), gold, 45, 30) == (0, 45)


def test_views_are_denser_and_keep_spans_whole(spark):
    words = [f"word{i}" for i in range(400)]
    words[200:202] = ["Ana", "Lee"]
    text = " ".join(words)
    gold = [span(text, "person", "Ana Lee")]
    found = training.views(text, gold, 8)
    assert len(found) == 1 and found[0][0] < gold[0][1] and gold[0][2] < found[0][1] and found[0][1] - found[0][0] < len(text) / 4
    assert training.views("short Ana Lee", [span("short Ana Lee", "person", "Ana Lee")], 8) == []
    docs = spark.createDataFrame([(1, "s", text, gold), (2, "t", "few words", [])], f"id long, source string, text string, entities {SPAN}")
    assert training.context_views(docs, ["id"], 8).count() == 1
    audit = {r["source"]: r for r in training.window_audit(docs, "source", "id", 8).collect()}
    assert audit["s"]["windows"] == 1 and audit[None]["docs"] == 2 and audit["s"]["window_density"] > audit["s"]["density"]


def test_probe(spark):
    real = spark.createDataFrame([(1, "a", 5, "five"), (2, "a", 1, "one"), (3, "a", 9, "nine"), (4, "b", 3, "three"), (5, "b", 1, "one")], "id long, source string, n int, text string")
    synthetic = spark.createDataFrame([(11, 2, "x"), (12, 1, "y"), (13, 3, "one")], "id long, draw int, text string")
    got = training.probe(real, synthetic, "source", "id", "n", "text", "draw", 4).collect()
    assert {r["text"] for r in got if r["real"]} == {"one", "nine", "three"} and {r["text"] for r in got if not r["real"]} == {"y"}
    with pytest.raises(ValueError):
        training.probe(real, synthetic, "source", "id", "n", "text", "draw", 2)
    rows = spark.createDataFrame([("g", [("org", 0, 1)]), ("h", [])], f"g string, entities {SPAN}")
    assert {r["g"]: len(r["missing"]) for r in training.supported(rows, "g").collect()} == {"g": 2, "h": 3}


def test_nearest_anchor(spark):
    rows = [(1, 0, "email", 0, 2), (1, 0, "person", 5, 9), (1, 0, "phone", 10, 12), (1, 0, "person", 20, 22), (1, 0, "phone", 30, 32), (1, 0, "org", 40, 42), (1, 1, "org", 50, 52), (1, 1, "email", 60, 62), (1, 2, "email", 70, 72)]
    got = training.nearest_anchor_contacts(spark.createDataFrame(rows, "doc long, block int, kind string, start int, end int"), ["doc"], "block").orderBy("start").collect()
    assert [r["owner"] for r in got] == [5, 5, 5, 20, 20, None, 50, 50, None]


POOLS = {"person": ["Ana Lee", "Bo Öz"], "org": ["ACME Ltd"], "address": ["5 Oak St, Denver, CO 80202"], "email": ["x@y.com"], "phone": ["+1 202-555-0143"], "city": ["Salem"], "date": ["May 1"], "number": ["7"], "word": ["w"]}


def test_templates():
    text, spans = generate.render("Dear {person#1}, {person_first#1} <{email#1}> of {org:upper} in {city}.", POOLS, Draw(1))
    data = text.encode()
    assert [k for k, _, _ in spans] == ["person", "email", "org"]
    name = data[spans[0][1] : spans[0][2]].decode()
    assert f", {name.split()[0]} <" in text and data[spans[2][1] : spans[2][2]] == b"ACME LTD"
    for bad in ("{nobody}", "{person", "person}", "{person:odd}", "{person#}", "{person#x}"):
        with pytest.raises(ValueError):
            generate.parse(bad)


def test_generated_documents(spark):
    templates = [("{person} at {address}", "both"), ("{person}", "no_address_with_person"), ("{address}", "no_person_with_address"), ("{word} x{number}", "nothing"), ("a{person}b", "no_address_with_person"), ("{word}", "both")]
    made = generate.documents(spark.range(400), templates, POOLS, 3)
    again = generate.documents(spark.range(400).repartition(7), templates, POOLS, 3)
    key = lambda df: sorted((r["id"], r["text"], r["reason"] or "") for r in df.collect())
    assert key(made) == key(again)
    assert {r["reason"] for r in made.collect()} == {None, "category_mismatch", "boundary_misaligned"}
    kept = generate.usable(made, "id", 6)
    assert {r["category"]: r["count"] for r in kept.groupBy("category").count().collect()} == {"both": 2, "no_address_with_person": 1, "no_person_with_address": 1, "nothing": 1}
    surfaces = spark.createDataFrame([("person", "ana lee")], "kind string, key string")
    texts = spark.createDataFrame([("w x7",)], "text string")
    left = [r["text"] for r in generate.usable(made, "id", 60, texts, surfaces).collect()]
    assert left and not any("Ana" in t for t in left) and "w x7" not in left
    assert generate.with_prefix("5 Oak St", "k", 1000).endswith("5 Oak St") and generate.with_prefix("5 Oak St", "k", 0) == "5 Oak St"


def test_clean_names(spark):
    people = spark.createDataFrame([("Ana Lee",), ("Ana",), ("R2 D2",), ("O'Neil, Bo",), ("Jean-Luc O’Neil Jr.",)], "name string")
    assert sorted(r[0] for r in generate.clean_people(people).collect()) == ["Ana Lee", "Jean-Luc O’Neil Jr."]
    orgs = spark.createDataFrame([("AB",), ("ACME",), ("The LEI Co",)], "name string")
    assert [r[0] for r in generate.clean_organizations(orgs).collect()] == ["ACME"]


def test_draws_are_even_and_independent():
    import numpy as np

    x = np.array([[d.uniform(), d.uniform()] for d in (Draw(1, i) for i in range(4000))])
    assert abs(x.mean(axis=0) - 0.5).max() < 0.02 and abs(np.corrcoef(x.T)[0, 1]) < 0.05


def test_silver_pieces_keep_what_can_be_learned(spark):
    text = "Ana Lee is é here.\n\nBob\n\nRoe works. Mail a@b.com now."
    gold = [span(text, "person", "Ana Lee"), span(text, "person", "Bob\n\nRoe"), span(text, "org", "b.com")]
    rows = training.silver_pieces(spark.createDataFrame([("x", text, gold), ("y", None, None)], f"id string, text string, entities {SPAN}"), most=6).collect()
    assert sum(len(r["entities"]) for r in rows) == 1 and sum(r["unreachable"] for r in rows) == 2
    assert all(r["text"].encode()[e["start"] : e["end"]] == b"Ana Lee" for r in rows for e in r["entities"])


def test_emails_go_to_whom_they_spell(spark):
    rows = [(1, 0, "person", 0, 8, "Ana Roe"), (1, 0, "person", 10, 18, "Bob Lee"), (1, 0, "email", 20, 30, "a.roe@x.com"), (1, 0, "email", 32, 40, "info@x.com"), (1, 1, "org", 50, 55, "ACME"), (1, 1, "email", 57, 60, "ana@x.com")]
    made = spark.createDataFrame(rows, "doc long, block int, kind string, start int, end int, text string")
    found = {r["start"]: r["owner"] for r in training.nearest_anchor_contacts(made, ["doc"], "block", "text").collect()}
    assert found == {0: 0, 10: 10, 20: 0, 32: 10, 50: 50, 57: 50}
    assert {r["start"]: r["owner"] for r in training.nearest_anchor_contacts(made, ["doc"], "block").collect()}[20] == 10


def test_scripts_tie_by_name_or_by_place(spark):
    rows = spark.createDataFrame([(1, 0, "alpha", "latin"), (1, 5, "alpha", "cyrillic"), (1, 9, "punct", "other")], "id long, start int, class string, script string")
    assert tokens.dominant_script(rows, ["id"]).first()["script"] == "cyrillic" and tokens.dominant_script(rows, ["id"], True).first()["script"] == "latin"


def test_documents_are_drawn_until_there_are_enough(spark):
    pools = {"person": [f"Ana N{chr(97 + i)}me" for i in range(20)], "org": ["ACME Ltd"], "address": [f"{i} Oak Street" for i in range(1, 30)], "email": ["x@a.com"], "phone": ["1"], "city": ["Rome"], "date": ["May"], "number": [str(i) for i in range(50)], "word": [f"w{i}" for i in range(50)]}
    templates = [("{person} lives at {address}.", "both"), ("{address} is {word}.", "no_person_with_address"), ("{person} is {word}.", "no_address_with_person"), ("Only {word} and {number}.", "nothing"), ("{word} {person}", "nothing")]
    found = generate.drawn(spark, 24, templates, pools)
    assert {r["category"]: r["count"] for r in found.groupBy("category").count().collect()} == {"both": 12, "nothing": 4, "no_person_with_address": 4, "no_address_with_person": 4}
    with pytest.raises(generate.Short):
        generate.drawn(spark, 24, templates[:2], pools, rounds=2)
    names = spark.createDataFrame([(f"Name {i}",) for i in range(200)] + [(None,), ("Name 1",)], "name string")
    out = spark.createDataFrame([("person", "name 3"), ("org", "name 4")], "kind string, key string")
    train, test = (generate.pool(names, "name", "person", split, out) for split in ("train", "test"))
    assert not set(train) & set(test) and "Name 3" not in train + test and len(train) == len(set(train)) > 100 and len(generate.pool(names, "name", "person", "train", most=5)) == 5


ENTITY = "array<struct<kind:string,text:string>>"


def test_separation_names_every_signal(spark):
    words = " ".join(f"w{i}" for i in range(20))
    schema = f"id long, text string, document string, entities {ENTITY}"
    train = [(1, "a", "url:x", []), (2, "b", None, [("org", "The  ACME")]), (3, "c", "url:q", [("email", "A@b.com"), ("phone", "+1 202-555-0143")]), (4, "so " + words, None, None), (5, "d", None, [("person", "Nobody")])]
    gold = [(9, "z", "url:x", [("org", "the acme"), ("email", "a@b.com")]), (8, words + " end", None, [("phone", "12025550143")])]
    found = leakage.separation(spark.createDataFrame(train, schema), spark.createDataFrame(gold, schema)).collect()
    assert sorted((r["signal"], r["id"], r["others"]) for r in found) == [("contact", 3, [8, 9]), ("document", 1, [9]), ("prose", 4, [8]), ("surface", 2, [9])]


def test_exclusions_are_checked_and_frozen(spark):
    schema = "name string, text string, expected array<struct<kind:string,start:int,end:int,text:string>>"
    of = lambda *rows: spark.createDataFrame(list(rows), schema)
    a, b = ("a", "é Ana Lee", [("person", 3, 6, "Ana"), ("person", 7, 10, "Lee")]), ("b", "none", [])
    assert leakage.frozen_exclusions([of(a), of(b)], 2).count() == 2
    for bad in ([of(a), of(a)], [of(a), of(("c", a[1], []))], [of(("d", "Ana", [("person", 0, 2, "Ana")]))], [of(("e", "Ana Lee", [("person", 0, 5, "Ana L"), ("person", 4, 7, "Lee")]))]):
        with pytest.raises(ValueError):
            leakage.frozen_exclusions(bad)
    with pytest.raises(ValueError):
        leakage.frozen_exclusions([of(a)], 371)


def test_notices_are_their_contact_sections(spark, tmp_path):
    body = "<p>SUMMARY: Nothing.\n\nADDRESSES: " + "Write to us at length. " * 12 + "\n\nOTHER PART: no</p>"
    rows = [{"document_number": "2024-1", "title": "T", "html_url": "u", "body": body}] * 2 + [{"document_number": "2024-2", "body": "<p>ADDRESSES: short</p>"}, {"document_number": None, "body": body}, {"document_number": "2024-3"}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, rows)))
    found = readers.notices(spark, str(tmp_path / "n.json")).collect()
    assert [r["id"] for r in found] == ["2024-1"] and found[0]["text"].startswith("ADDRESSES:\nWrite") and "OTHER" not in found[0]["text"]
