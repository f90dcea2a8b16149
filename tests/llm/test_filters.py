"""Decontamination, URL rules, archives and binary codes against brute force and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontam, hamming, urlfilter, warc
from tidegrid.llm.shared import shared_dir
from tidegrid.llm.words import words_of

LETTERS = [a + b for a in "bcdfg" for b in "aeiou"]


def greedy(item, doc, least):
    """Greedy string tiling, straight from its definition."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_i[a + n] and free_d[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((a, b, n))
        for k in range(n):
            free_i[a + k] = free_d[b + k] = False


@pytest.mark.parametrize("seed", range(20))
def test_tiles_equal_the_definition(seed):
    rng = random.Random(seed)
    item = [rng.choice(LETTERS[:4]) for _ in range(20)]
    doc = [rng.choice(LETTERS[:4]) for _ in range(rng.choice([5, 40]))] + item[10:] + item[:10]
    index = decontam.Benchmark([0], [" ".join(item)], 3)
    got = [t for _, _, tiles in index.matches([" ".join(doc)]) for t in tiles]
    assert got == greedy(item, doc, 3)


def test_reordered_passages_are_caught_and_clean_ones_are_not(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(LETTERS) + rng.choice(LETTERS) for _ in range(n))
    items = [(1, prose(30)), (2, "tiny item"), (3, None), (4, ""), (5, prose(30))]
    w = items[0][1].split()
    moved = " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10])
    docs = [(10, f"{prose(50)} {moved} {prose(20)}"), (11, prose(300)), (12, None), (13, ""), (14, "a tiny ITEM here"), (15, " ".join(w[:14])), (10, items[4][1])]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.SLICE_BYTES, 150, 1):
        got = sorted((r["doc_id"], r["item_id"], round(r["coverage"], 3), len(r["tiles"])) for r in decontam.contaminated(d, b, slice_bytes=size).collect())
        assert got == [(10, 1, 1.0, 3), (10, 5, 1.0, 1), (14, 2, 1.0, 1)]
        assert decontam.contaminated(d, b, slice_bytes=size)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_repeated_words_are_joined_in_blocks(monkeypatch):
    rng = random.Random(6)
    item, doc = [rng.choice("ab") for _ in range(40)], [rng.choice("ab") for _ in range(120)]
    whole = list(decontam.Benchmark([0], [" ".join(item)], 3).matches([" ".join(doc)]))
    monkeypatch.setattr(decontam, "SEEDS", 5)
    assert list(decontam.Benchmark([0], [" ".join(item)], 3).matches([" ".join(doc)])) == whole
    assert [t for _, _, tiles in whole for t in tiles] == greedy(item, doc, 3)


def test_equal_words_by_the_thousand_stay_in_memory():
    import tracemalloc

    index = decontam.Benchmark([0], ["a " * 300], 5)
    tracemalloc.start()
    ((_, _, tiles),) = index.matches(["a " * 20_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 300)] and peak < 300 << 20


def test_repeated_items_give_a_row_each(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "two three four five six")] * 3 + [(None, "one two three four five")], "item_id long, text string")
    assert sorted(str(r["item_id"]) for r in decontam.contaminated(d, b).collect()) == ["7", "7", "7", "None"]


def test_letters_are_folded_one_by_one():
    from tidegrid.llm.words import words_of

    a, b = words_of(["İ É ΟΔΟΣ straße"]), words_of(["İ é οδοσ straße"])
    assert a.hashes.tolist() == b.hashes.tolist()
    assert words_of(["É"]).hashes[0] == a.hashes[1]


URLS = ["http://www.example.com/en/x", "https://A.Example.COM/en/", "http://example.net/es/1?q", "http://example.net", "http://x.org/en/", None, "no scheme", "http://example.com#f", "http://example.net/fr/#/es/", "http://notexample.com/en/", "http://com/", "ftp://a?://b/net"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute_rule(host, path):
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[2], max(fit)[3]) if fit else (None, "allow")


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_on_urls(spark, broadcast):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urlfilter.judge(pages, rules, most_index_bytes=1 << 20 if broadcast else 0).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r["rule"], r["verdict"]) == brute_rule(r["host"], r["path"]), r
    parts = {r["page_id"]: (r["host"], r["path"]) for r in out}
    assert parts[1] == ("a.example.com", "/en/") and parts[3] == ("example.net", "") and parts[5] == ("", "") == parts[6] and parts[11] == ("a", "")


def test_no_rules_and_no_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urlfilter.judge(pages, []).first()["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_equal_keys_are_told_apart_by_their_strings(monkeypatch):
    monkeypatch.setattr(urlfilter, "digest", lambda text: 7)
    index = urlfilter.DigestArray(np.frombuffer(urlfilter.DigestArray.build(RULES), np.uint8))
    rules, verdicts = urlfilter.judge_array(["www.example.com", "b.net", "b.org"], ["/en/", "/fr/z", "/fr/"], index, "allow")
    assert rules == ["www.example.com/en/", "net/fr/", None] and verdicts == ["allow", "block", "allow"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://b.org/x y", "<p>one é</p>"), (1, "https://A.b.org:80/q?z=1#f", "<p>one é</p>"), (2, None, None), (7, "bad url", ""), (9, "http://b.org/x y", "two " * 5000), (5, "http://c.net", "<p>one é</p>"), (9, "http://b.org/again", "two " * 5000)]
    return spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_give_back_what_was_written(spark, pages):
    out = sorted(tuple(r) for r in warc.archive(pages).collect() for r in [[r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1]])
    rows = pages.collect()
    first = {}
    for r in rows:
        first[r["html"] or ""] = min(first.get(r["html"] or "", 1 << 60), r["page_id"])
    want = []
    for r in rows:
        data = (r["html"] or "").encode()
        f = first[r["html"] or ""]
        want.append((r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == r["page_id"] else "revisit", -1 if f == r["page_id"] else f))
    assert out == sorted(want)
    assert {r["record_type"] for r in warc.archive(pages, least_bytes=1 << 20).collect()} == {"response"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_lookups_by_url(spark, pages):
    folder = shared_dir(spark)
    directory = warc.build_index(warc.write(pages, f"{folder}/a"), f"{folder}/i", lines=2)
    assert sum(len(warc.directory_of(r["file"])) for r in directory.collect()) >= 3
    wanted = spark.createDataFrame([("http://b.org/x y",), ("https://a.B.org:80/q?z=1#f",), ("http://absent.org/",), (None,)], "url string")
    got = sorted((r["page_id"], r["record_type"], None if r["payload"] is None else bytes(r["payload"]).decode()[:8]) for r in warc.lookup(directory, wanted).collect())
    assert got == [(1, "response", "<p>one é"), (2, "response", ""), (3, "revisit", None), (9, "response", "two two ")]


def test_keys_sort_hosts_from_the_right():
    assert warc.url_key("http://Www.Example.com/a b?c") == "com,example,www)/a%20b?c"
    assert warc.url_key(None) == "-" and warc.url_key("http://a.b") == "b,a)/"


@pytest.mark.parametrize("bits", [40, 64, 130])
def test_search_is_exact(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(4, bits))
    vectors = [list(map(float, centres[i % 4] + rng.normal(0, 0.6, bits))) for i in range(300)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(1000, None, "x"), (7, vectors[7], "x"), (1001, [float("nan")] * bits, "x")]
    words = -(-bits // 64)
    codes = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance string").select("vec_id", hamming.sign_code(F.col("embedding"), words).alias("code"), "distance")
    got = hamming.top_k(codes, codes.where("vec_id % 20 = 0"), k=7, shard_rows=90, query_rows=6).collect()
    all_bits = [(i, np.array(v) > 0) for i, v, _ in rows if v is not None]
    want = []
    for q, a in all_bits:
        if q % 20 == 0:
            near = sorted((int((a != b).sum()), i) for i, b in all_bits if i != q)[:7]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == sorted(want)
    assert hamming.top_k(codes.limit(0), codes).count() == 0 == hamming.top_k(codes, codes.limit(0)).count()


def test_words_are_the_same_in_any_company():
    alone, among = words_of(["Some words here"]), words_of(["x", "Some words here", "y"])
    assert (alone.hashes == among.hashes[1:4]).all()
