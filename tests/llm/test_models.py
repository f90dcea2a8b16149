"""Classifiers: held-out accuracy on texts made here, and the defined cases."""

import random

import numpy as np
import pytest

from tidegrid.llm import langid, quality, toxicity

WORDS = {"en": "the and of that with from their which would there".split(), "fr": "les des une dans pour avec été cette leurs où".split(), "de": "der die und nicht über werden für können auch einer".split()}


def sentence(rng, lang, n=14):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang, "x") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(240))]
    odd = [(900, None, "en", "x"), (901, "", "en", "x"), (902, "123 -- 45!", "fr", "x"), (903, sentence(rng, "de") * 3000, None, "x"), (0, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")


def test_language_of_held_out_texts(docs):
    from pyspark.sql import functions as F

    model = langid.train(docs.where("doc_id % 3 != 0"), per_language=60)
    out = {r["doc_id"]: r for r in langid.predict(docs, model, keep=(F.col("doc_id"), F.col("lang"))).collect()}
    held = [r for i, r in out.items() if i < 900 and i % 3 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["lang_pred"] == "de" and 0 <= out[903]["score"] <= 1


def test_letters_of_any_script_and_nothing_else_have_a_language():
    model = langid.LanguageModel(["a", "b"], np.ones(langid.DIMENSIONS, np.float32), np.zeros((langid.DIMENSIONS, 2), np.float32), np.zeros(2, np.float32), 1.0)
    for text in ("½ ²", "①", "Ⅷ", "\u0301", "12_3 €!", "", None):
        assert model.predict(text) == ("und", 0.0), text
    for text in ("x", "я", "語", "ª", "ʰ", "1 é 2"):
        assert model.predict(text) == ("a", 0.5), text  # of equal scores the first in sorted order


def test_every_language_is_learned_within_the_bound_of_bytes(spark):
    rng = random.Random(8)
    names = [f"l{i:03}" for i in range(230)]
    own = {n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + rng.choice("bcdfgh") for _ in range(4)] for n in names}
    rows = [(i, " ".join(rng.choice(own[n]) for _ in range(30)), n, 1.0) for i, n in enumerate(names * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, share_ double")
    model = langid.train(docs, passes=1)
    assert model.languages == names
    sample = langid._sample(docs, "text", "lang", "doc_id", 1000, 40_000)
    assert len(sample) < 0.6 * len(rows)


def test_the_driver_gets_the_model_and_not_the_sample(docs, monkeypatch):
    args = ("text", "lang", "doc_id", 60, 1 << 24)
    known = docs.where("lang IS NOT NULL")
    expected = langid.fitted(langid._sample(known, *args), langid.document_frequencies(known), 3, 0.5, 1.0, 0.02, 0.05, 7)
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("a sample came to the driver"))
    model = langid.train(docs, per_language=60)
    assert model.languages == expected.languages and model.temperature == expected.temperature
    assert all(np.allclose(getattr(model, x), getattr(expected, x), 1e-4, 1e-6) for x in ("idf", "weights", "bias"))


def test_language_of_null_ids_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = [(None, sentence(random.Random(i), lang), lang) for i in range(8) for lang in ("en", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert langid.predict(docs, model, keep=(F.col("doc_id"),)).count() == 16
    assert langid.predict(docs.limit(0), model, keep=(F.col("doc_id"),)).count() == 0


def test_language_counts_do_not_depend_on_stretches(monkeypatch):
    text = "où est la bibliothèque " * 50
    whole = langid.counts_of(text)
    monkeypatch.setattr(langid, "STRETCH", 37)
    assert (langid.counts_of(text) == whole).all()


def test_nothing_to_learn_from(docs, spark):
    model = langid.train(docs.limit(0))
    assert model.predict("hello there") == ("und", 0.0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels).score("any") == 0.5
    assert toxicity.train(docs, labels).score("any") == 0.5


def test_quality_network_scans_whole_texts():
    rng = random.Random(2)
    good = [sentence(rng, "en", 40) for _ in range(60)]
    bad = [good[i][:80] + " @@@@ $$$$ ####" for i in range(60)]
    model = quality.fit(good + bad, [1] * 60 + [0] * 60, passes=8)
    assert np.mean([model.score(t) >= 0.5 for t in good]) > 0.9 and np.mean([model.score(t) < 0.5 for t in bad]) > 0.9
    long = sentence(rng, "en", 40) * 2000
    whole = quality._bytes(long)
    direct = np.maximum(model.responses(whole).max(axis=0) + model.bias, 0)
    assert np.allclose(model.chunk_maxima(long).max(axis=0), direct)
    for odd in (None, "", "a"):
        assert 0 <= model.score(odd) <= 1


def test_toxic_words_are_found_anywhere_and_group_names_do_not_count():
    rng = random.Random(3)
    clean = [sentence(rng, "en") + (" the women here." if i % 10 == 0 else "") for i in range(120)]
    toxic = [sentence(rng, "en") + " you scum." + (" the women here." if i % 2 else "") for i in range(60)]
    texts, labels = clean + toxic, [0] * 120 + [1] * 60
    plain = toxicity.fit(texts, labels, fairness=0.0, l1=0.3)
    fair = toxicity.fit(texts, labels, fairness=50.0, l1=0.3)
    shift = lambda m: abs(m.logit(np.unique(toxicity.features("the women here."))) - m.logit(np.unique(toxicity.features("the men here."))))
    assert shift(fair) < 0.5 * shift(plain)
    assert fair.score(sentence(rng, "en") * 400 + " you scum.") > 0.5 > fair.score(sentence(rng, "en") * 400)
    for odd in (None, ""):
        assert 0 <= fair.score(odd) <= 1


def test_part_of_a_toxic_phrase_is_found_in_a_long_text():
    rng = random.Random(3)
    texts = [sentence(rng, "en") for _ in range(120)] + [sentence(rng, "en") + " you scum." for _ in range(60)]
    model = toxicity.fit(texts, [0] * 120 + [1] * 60, fairness=50.0, l1=0.3)
    assert model.score(sentence(rng, "en") * 400 + " scum") > 0.5


def test_counterfactuals_swap_every_name():
    assert toxicity.counterfactuals("Men met women. None here.") == [("Men met women.", "women met men.")]


def test_scores_over_frames(docs, spark):
    from pyspark.sql import functions as F

    labels = docs.where("doc_id < 200").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality.train(docs, labels, per_class=20, passes=2)
    out = quality.score(docs, model, keep=(F.col("doc_id"), F.col("score").alias("extra")), threshold=0.3)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.score(docs.limit(0), model, keep=(F.col("doc_id"),)).count() == 0


def test_a_language_of_long_texts_alone_is_learned(spark):
    from tidegrid.llm import langid

    rng = random.Random(2)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcd", 30), "xx") for i in range(40)] + [(100, text("wxyz", 60_000), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most_bytes=20_000)
    assert model.languages == ["xx", "yy"] and model.predict(text("wxyz", 50))[0] == "yy" and model.predict(text("abcd", 50))[0] == "xx"


def test_samples_follow_shares_of_any_size(spark):
    from pyspark.sql import functions as F

    from tidegrid.llm.quality import labelled_sample
    from tidegrid.llm.shared import chosen_by_hash

    ids = spark.range(200_000).select(F.col("id").cast("string").alias("id"))
    count = lambda share: ids.where(chosen_by_hash(F.col("id"), 5, F.lit(share))).count()
    assert count(1.0) == 200_000 and 900 < count(0.005) < 1100 and count(1e-9) == 0
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(400)], "doc_id long, quality int")  # each label twenty times
    assert len(labelled_sample(docs, labels, "quality", 5, 1 << 16)) <= 20 and len(labelled_sample(docs, labels, "quality", 500, 1 << 16)) == 20
