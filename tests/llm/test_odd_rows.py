"""Long texts, ties, repeated rows and null ids through frames, and queries against their SQL."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontam, langid, minhash, quality, queries, substring, toxicity, urlfilter

FOLDER = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def long_texts(spark):
    """A text of over a million characters, the same with one word changed, one that holds its middle, two clean ones."""
    rng = random.Random(11)
    words = prose(rng, 160_000).split()
    near = words[:]
    near[80_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, prose(rng, 50) + " " + " ".join(words[70_000:70_200]) + " " + prose(rng, 50)), (4, prose(rng, 200)), (5, prose(rng, 90_000))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_long_texts_have_classes(long_texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(long_texts, threshold=0.8, width=5).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def test_long_texts_are_decontaminated(spark, long_texts):
    words = long_texts.where("doc_id = 1").first()["text"].split()
    items = spark.createDataFrame([(7, " ".join(words[150_000:150_040])), (8, " ".join(words[70_100:70_160]))], "item_id long, text string")
    for size in (decontam.SLICE_BYTES, 1):
        found = decontam.contaminated(long_texts, items, slice_bytes=size).collect()
        assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in found) == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, 1.0), (2, 8, 1.0), (3, 8, 1.0)]


def test_batches_are_held_up_to_a_bound():
    batches = [pd.DataFrame({"id": [i, None], "text": ["x" * 10, None]}) for i in range(5)]
    sizes = [len(ids) for ids, _ in decontam._together(iter(batches), 25)]
    assert sizes == [6, 4] and [len(ids) for ids, _ in decontam._together(iter(batches), 0)] == [2] * 5
    assert list(decontam._together(iter([]), 25)) == []


def test_passages_of_long_texts_and_of_repeated_rows(spark, long_texts):
    marked = {r["doc_id"] for r in substring.repeated_passages(long_texts).collect()}
    assert marked == {2, 3}
    rng = random.Random(12)
    text = prose(rng, 60) + "."
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"] for r in substring.repeated_passages(twice).collect()} >= {2}


def test_addresses_of_repeated_rows(spark):
    url = "http://www.example.com/en/" + "x" * 200_000
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://example.com/en/"), (None, None)], "page_id long, url string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    got = sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in urlfilter.judge(pages, rules).collect())
    assert got == [(0, "", "allow"), (1, "www.example.com/en/", "allow"), (1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block")]


def test_languages_that_tie_have_one_answer(spark):
    """Two languages with the same texts: every run gives the same one of them."""
    rows = [(i, f"abcd efgh {i // 2}", "xx" if i % 2 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    answers = {model.predict("abcd efgh") for _ in range(3)}
    assert len(answers) == 1 and answers.pop()[0] in ("xx", "yy")


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_scores_of_null_ids_and_long_texts(spark, kind):
    rng = random.Random(13)
    rows = [(i, prose(rng, 40) + (" zzzz yyyy" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None), (None, prose(rng, 30)), (900, prose(rng, 40_000)), (900, "")], "doc_id long, text string")
    name = {"quality": "quality", "toxicity": "toxic"}[kind]
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (None, 1), (900, None)], f"doc_id long, {name} int")
    module = {"quality": quality, "toxicity": toxicity}[kind]
    model = module.train(docs, labels)
    out = quality.score(docs, model, keep=(F.col("doc_id"),)).collect()
    assert len(out) == 64 and all(0 <= r["score"] <= 1 for r in out)


@pytest.mark.parametrize("name", ["op5_urls", "op7_warc", "op10_hamming"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(FOLDER, table)}.parquet'")
    columns = db.sql(queries.ORACLE_SQL[name]).columns
    want = sorted(map(repr, db.sql(queries.ORACLE_SQL[name]).fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in queries.QUERIES[name](spark, FOLDER).collect()) == want
