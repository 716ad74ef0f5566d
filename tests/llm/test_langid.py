import zlib

import numpy as np
import pytest

from gleaner.llm import langid

WORDS = {"en": "the and of that with there which this from have water green house".split(), "fr": "le la les que dans avec pour une être maison verte eau où".split()}


def corpus(n=160):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 30)), lang, None))
    return rows


def test_held_out_accuracy_and_edges(docs):
    rows = corpus() + [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", None), (1003, "the water and the house", None), (1003, "the water and the house", None), (None, "les maisons que la", "fr")]
    found = langid.identify(docs(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    held = [r for r in rows[:160] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(by_id[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows[:160])
    assert np.mean([by_id[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003]["lang_pred"] == "en" and by_id[None]["held_out"] and by_id[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_nothing_to_learn_and_empty_table(docs):
    assert [r["lang_pred"] for r in langid.identify(docs([(1, "some words", None, None)])).collect()] == ["und"]
    assert langid.identify(docs([])).count() == 0


def test_keep_leaves_columns_and_drops_what_has_no_language(docs):
    made = docs(corpus() + [(2000, None, "en"), (2001, "…!", "fr")])
    kept = langid.keep(made)
    assert kept.columns == made.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(160))


def test_predictions_equal_a_model_by_hand(docs):
    """The whole operator against plain Python: folds, counts of n-grams, document frequencies, sample, temperature."""
    rows = corpus(120) + [(700, None, "en"), (701, "…", "fr"), (702, "green maison", None)]
    found = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    taught = sorted((lang, i, text) for i, text, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2)

    def grams(text):
        stream = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower())
        stream, out = " ".join(stream.split()), {}
        if not stream:
            return out
        stream = f" {stream} "
        for n in range(4):
            for k in range(len(stream) - n):
                h = 0
                for m, c in enumerate(stream[k : k + n + 1]):
                    h = (h * 0x9E3779B1 + ord(c) + m) % 2**32 if m else ord(c)
                bucket = (h * 0x85EBCA6B) % 2**32 >> 16
                out[bucket] = out.get(bucket, 0) + 1
        return out

    counted = [(lang, grams(text)) for lang, _, text in taught if grams(text)]
    df = {}
    for _, own in counted:
        for b in own:
            df[b] = df.get(b, 0) + 1
    idf = np.array([np.log((1 + len(counted)) / (1 + df.get(b, 0))) + 1 for b in range(langid.BUCKETS)])
    model = langid.Model(["en", "fr"], idf, np.zeros((langid.BUCKETS + 1, 2)))
    arrays = lambda own: (np.array(sorted(own)), np.array([own[b] for b in sorted(own)], float))
    rows_of = [(*model.features(*arrays(own)), ["en", "fr"].index(lang)) for lang, own in counted]
    model.weights = langid.ftrl([r for k, r in enumerate(rows_of) if k % 5 != 4], 2)
    model.temperature = langid.best_temperature([x @ model.weights[i] for k, (i, x, _) in enumerate(rows_of) if k % 5 == 4], [y for k, (*_, y) in enumerate(rows_of) if k % 5 == 4])
    for i, text, *_ in rows:
        own = grams(text)
        p = langid.softmax(model.logits(*arrays(own)) / model.temperature) if own else None
        assert found[i]["lang_pred"] == ("und" if p is None else model.labels[int(p.argmax())])
        assert found[i]["score"] == pytest.approx(0.0 if p is None else p.max(), abs=1e-4)


@pytest.mark.parametrize("text", ["ab " * 50, "  Ünïcode\nwörds, 12 and ΟΔΥΣΣΕΥΣ", "a", "a b", "", "...", "x" * 40 + "!" * 40 + "y", "ab.", None])
@pytest.mark.parametrize("part", [1, 2, 3, 7, 64])
def test_long_texts_are_read_whole_whatever_the_parts(monkeypatch, text, part):
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "_PART", part)
    cut = langid.grams(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_grams_count_every_run_of_letters_with_its_edges():
    at, counts = langid.grams("Ab, ab")  # " ab ab "
    assert counts.sum() == 7 + 6 + 5 + 4 and sorted(counts.tolist())[-1] == 3 and len(langid.grams("ab" * langid._PART)[0]) == len(langid.grams("ab" * 9)[0])


def test_more_labels_than_are_learned(docs, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 60)
    rows = corpus() + [(3000 + i, "qqq www zzz", f"rare{i}", None) for i in range(30)]
    found = langid.identify(docs(rows), most_labels=2).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found} == {"en", "fr"}


def test_ftrl_is_sparse_and_temperature_finds_least_loss():
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 2 + rng.integers(0, 50)], np.int32), np.ones(2, np.float32), k % 2) for k in range(400)]
    w = langid.ftrl(rows, 2, l1=0.5)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[2:52] == 0).mean() > 0.5
    logits = [np.array([4.0, 0.0])] * 80 + [np.array([0.0, 4.0])] * 20
    t = langid.best_temperature(logits, [0] * 100)
    assert 1 < t < 20
    assert t == pytest.approx(4 / np.log(4), rel=0.02)
