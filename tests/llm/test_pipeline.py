"""The stages of the pipeline against brute force, and its defined cases."""

import hashlib
import random

import pytest

import corpus_pipeline
from tidegrid.llm.queries import vocabulary_path

WORDS = {"en": "the and of that with from their which would there".split(), "fr": "les des une dans pour avec été cette leurs où".split()}
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, rank string, score string"


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice("bcdfghklmnp") + rng.choice("aeiou") * 2]) for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, 120) + ".", lang) for i, lang in enumerate(rng.choice(["en", "fr"]) for _ in range(60))]
    passage, item = prose(rng, "en", 70), prose(rng, "en", 40)
    words = rows[5][1].split()
    rows += [
        (100, " ".join([*words[:60], "changed", *words[61:]]), rows[5][2]),  # near copies of 5
        (101, rows[5][1], rows[5][2]),
        (102, f"{prose(rng, 'en', 50)} {passage} {prose(rng, 'en', 50)}", "en"),
        (103, f"{prose(rng, 'en', 40)} {passage} {prose(rng, 'en', 60)}", "en"),  # repeats the passage of 102
        (104, f"{prose(rng, 'en', 60)} {' '.join(item.split()[20:])} x {' '.join(item.split()[:20])}", "en"),  # the item, reordered
        (105, None, "en"), (106, "", "fr"), (107, "12 34 !?", "en"), (None, prose(rng, "en", 90), "en"), (None, None, None), (7, rows[7][1], rows[7][2]),
    ]
    return [(i, t, lang, "s", None if t is None else len(t), "r", "c") for i, t, lang in rows], item, passage


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(made[0], FIELDS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, made[1]), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_brute_force(spark, made, folder):
    rows, item, passage = made
    (_, language), (_, near), (_, cut), (_, clean), (_, encode) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = language(spark, docs, folder).cache()
    assert first.columns == docs.columns
    want = sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)
    assert rows_of(first) == want

    kept, seen = [], []
    for r in sorted(want, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())):
        s = shingles(r[1])
        if all(len(s & o) < 0.8 * len(s | o) for o in seen):
            kept.append(r)
        seen.append(s)
    second = near(spark, first, folder).cache()
    assert rows_of(second) == sorted(kept, key=repr) and {100, 101} & {r[0] for r in kept} == set()

    third = cut(spark, second, folder).cache()
    after = {r["doc_id"]: r for r in third.collect() if r["doc_id"] is not None}
    before = {r[0]: r[1] for r in kept if r[0] is not None}
    assert set(after) == set(before) and third.columns == docs.columns
    assert {i for i in after if after[i]["text"] != before[i]} == {103}
    gone = passage.split()
    left = after[103]["text"].split()
    own = [w for w in before[103].split()]
    assert len(own) - 72 <= len(left) <= len(own) - 58 and " ".join(gone[10:60]) not in after[103]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())

    fourth = clean(spark, third, folder).cache()
    assert {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in third.collect()} - {104}

    import tokenizers

    reference = tokenizers.Tokenizer.from_file(vocabulary_path())
    fifth = sorted((r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in encode(spark, fourth, folder).collect())
    expected = []
    for r in fourth.collect():
        ids = reference.encode(r["text"], add_special_tokens=False).ids
        expected.append((hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert fifth == sorted(expected)


def test_empty_documents_pass_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and docs.columns == FIELDS.replace(" long", "").replace(" string", "").split(", ")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
