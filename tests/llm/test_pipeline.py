import numpy as np

import corpus_pipeline
from gleaner.llm import langid, packing, quality, simhash
from tests.llm.test_langid import WORDS


def tables(spark, path, n=240):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(n):
        lang, good = ("en", "fr")[i % 2], i % 4 > 0
        words = rng.choice(WORDS[lang], 60).tolist()
        text = " ".join(words) + "." if good else " ".join(f"{w.upper()}!!!" for w in words[:5] * 8)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        marks.append((i, int(good), 0))
    rows += [(n + i, rows[i + 1][1], "en", "s0", 0) for i in range(0, 40, 4)]  # copies of good ones
    rows += [(900, None, "en", "s0", 0), (901, "…", "en", "s1", 1), (902, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, {i for i, q, _ in marks if q}


def test_stages_decide_and_hand_on(spark, tmp_path):
    rows, good = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{k}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if k < 4:
            assert docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in seen[name].collect()]
    known = set(ids("language ID"))
    assert known == {r[0] for r in rows} - {900, 901, 902}
    kept = ids("quality classifier")
    assert len(set(kept) & good) > 0.95 * len(good) and not set(kept) & {i for i in range(240) if i % 4 == 0}
    one = ids("SimHash near-dedup")
    groups = {}
    for r in simhash.groups(seen["quality classifier"]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(one) == sorted(groups)
    assert not set(one) & set(range(240, 250))
    mixed = ids("mixing sources")
    assert set(mixed) <= set(one) and max(mixed.count(i) for i in set(mixed)) <= 2
    packed = seen["best-fit packing"].collect()
    assert len([r for r in packed if r["piece"] == 0]) == len(mixed)


def test_run_applies_all_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_take_clashing_columns_long_texts_repeats_and_nulls(spark, tmp_path):
    rows, good = tables(spark, str(tmp_path))
    rng = np.random.default_rng(4)
    long, other = (" ".join(rng.choice(WORDS[lang], 150_000)) + "." for lang in ("en", "fr"))
    extra = [(5000, long, "en", "s9"), (5001, other, None, None), *[(5002, rows[3][1] + " once more", "fr", "s1")] * 3, (None, rows[5][1] + " without an id", "fr", None)]
    wide = [(*(r[:4]), 1, 2, 0.5, "x", "y", 3, [1], 4) for r in [*rows, *extra]]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, __salt int, score double, row string, d string, fp long, draws array<int>, size int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/wide{k}.parquet")
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = spark.read.parquet(f"{tmp_path}/wide{k}.parquet")
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            if k < 2:
                assert {5000, 5001, 5002, None} <= set(ids) and ids.count(5002) == 3
            if k == 2:
                assert {5000, 5001} <= set(ids) and ids.count(5002) <= 1
            lengths = {r["doc_id"]: r["n"] for r in docs.selectExpr("doc_id", "length(text) as n").collect()}
            assert lengths.get(5000, len(long)) == len(long)
    packed = spark.read.parquet(f"{tmp_path}/wide4.parquet")
    assert  packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_keep_one_of_rows_without_ids_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 2), (None, "q r s t u v", 1), (5, long, 1), (5, long, 1), (5, "other words in this one here", 1), (7, long, 3), (8, None, 1), (9, "", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, root int")
    kept = simhash.keep_one(made)
    assert kept.columns == made.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [g[:2] for g in got if not g[0]] == [(False, 0)] * 2
    assert [g[1] for g in got if g[0]] == [5, 5, 8]
    assert {langid.__name__, quality.__name__, packing.__name__}
