"""Queries of the operators of this subpackage over the test tables, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontam, hamming, langid, lexical, minhash, quality, rangejoin, substring, toxicity, turns, urlfilter, warc
from tidegrid.llm.shared import crc_of_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine and, as it is an installed package, on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def learnable_languages(docs: DataFrame) -> DataFrame:
    """Text and language of the documents that language models may learn from."""
    return docs.where(F.pmod(crc_of_id(), F.lit(4)) != 2).select("doc_id", "text", "lang")


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = (F.pmod(crc_of_id(), F.lit(4)) == 2).alias("held_out")
    return langid.predict(docs, langid.train(learnable_languages(docs)), keep=(F.col("doc_id"), held_out))


def learnable_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents that classifiers may learn from."""
    return labels.where(F.pmod(crc_of_id(), F.lit(5)) != 0)


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out")
    model = quality.train(docs.select("doc_id", "text"), learnable_labels(labels))
    return quality.score(docs, model, keep=(F.col("doc_id"), held_out), threshold=0.3)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out")
    model = toxicity.train(docs.select("doc_id", "text"), learnable_labels(labels))
    return quality.score(docs, model, keep=(F.col("doc_id"), held_out), threshold=0.5)


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op5_urls"] = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
  coalesce(arg_max(rule_verdict, length(rule_host || rule_path) * 1000 + length(rule_host)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back."""
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)


ORACLE_SQL["op7_warc"] = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
linked AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM linked
"""


@query
def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, with the item."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_match=5, threshold=0.5)
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


@query
def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every twentieth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    codes = vectors.select("vec_id", hamming.sign_code(F.col("embedding"), max(1, -(-longest // 64))).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), k=10)


ORACLE_SQL["op10_hamming"] = """
WITH signs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS s FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    CAST(list_sum(list_transform(list_zip(q.s, r.s), lambda z: CASE WHEN coalesce(z[1], 0) <> coalesce(z[2], 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM signs q JOIN signs r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that repeat a passage of an earlier document."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"), threshold=0.8, least_words=6, run_words=20)


@query
def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return rangejoin.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


ORACLE_SQL["op11_vectors"] = """
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
valid AS (
  SELECT vec_id, e FROM given
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached(u, v) AS (SELECT vec_id, vec_id FROM given UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u),
least AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM given JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""


@query
def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by a hash of the place."""
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def _op12_sql() -> str:
    """Costs to go are carried backward over the rows of a conversation by one recursion, the walk forward by another."""
    insert = lambda c: [f"least({c[0]}, 3 + {c[2]}, 6 + {c[3]})", f"least({c[1]}, 3 + {c[2]}, 6 + {c[3]})", f"least({c[2]}, 3 + {c[3]})", f"least({c[3]}, 3 + {c[2]})"]
    late = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    gone = "coalesce(fault IN ('blank', 'duplicate'), false)"
    base = []
    for state, after in enumerate((2, 2, 3, 2)):
        keep = {0: "CASE WHEN initial = 's' THEN c1 WHEN initial = 'u' THEN c2 END", 2: "CASE WHEN initial = 'a' THEN c3 END"}.get(state, "CASE WHEN initial = 'u' THEN c2 END")
        base.append(f"least(4 + c{state}, CASE WHEN NOT {gone} THEN 3 + {late} + c{after} END, CASE WHEN NOT {gone} THEN {late} + {keep} END)")
    return f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(acc, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM damaged),
judged AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
costs(conv_id, i, c0, c1, c2, c3) AS (
  SELECT conv_id, n + 1, 0, 6, 3, 0 FROM judged WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {", ".join(insert(["b0", "b1", "b2", "b3"]))}
  FROM (SELECT j.conv_id, j.i, {", ".join(f"{b} AS b{s}" for s, b in enumerate(base))} FROM costs c JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i - 1)),
walk(conv_id, i, state, audit, turns) AS (
  SELECT conv_id, 1, 0, '', CAST([] AS VARCHAR[]) FROM judged WHERE i = 1
  UNION ALL
  SELECT conv_id, i + CASE WHEN edit = 'I' THEN 0 ELSE 1 END, CASE edit WHEN 'D' THEN state WHEN 'K' THEN kept ELSE following END, audit || edit,
    CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text)
      WHEN 'R' THEN list_append(turns, CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || text) ELSE list_append(turns, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM (
    SELECT *, CASE WHEN fault IS NULL AND role IS NULL THEN 'I' WHEN 4 + after[state + 1] = now[state + 1] THEN 'D' WHEN 3 + now[following + 1] = now[state + 1] THEN 'I'
      WHEN NOT {gone} AND kept IS NOT NULL AND {late} + after[kept + 1] = now[state + 1] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT w.*, j.role, j.text, j.fault, CASE WHEN w.state = 2 THEN 3 ELSE 2 END AS following,
        CASE WHEN j.initial = 's' AND w.state = 0 THEN 1 WHEN j.initial = 'u' AND w.state <> 2 THEN 2 WHEN j.initial = 'a' AND w.state = 2 THEN 3 END AS kept,
        [c.c0, c.c1, c.c2, c.c3] AS now, [d.c0, d.c1, d.c2, d.c3] AS after
      FROM walk w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i
        LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i LEFT JOIN costs d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1
      WHERE j.i IS NOT NULL OR w.state IN (1, 2)))),
ends AS (SELECT conv_id, arg_max(audit, strlen(audit)) AS audit, arg_max(turns, strlen(audit)) AS turns FROM walk WHERE state IN (0, 3) AND i = (SELECT count(*) + 1 FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM walk.conv_id) GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(c0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = 1
"""


ORACLE_SQL["op12_turns"] = _op12_sql()


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op13_lexical"] = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
docs AS (SELECT doc_id, row, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
held AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
weighed AS (SELECT item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN held USING (term), stats),
scored AS (
  SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * stats.docs) // total)))) AS BIGINT) AS score
  FROM weighed JOIN postings USING (term) JOIN docs USING (row), stats GROUP BY item_id, row),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN docs USING (row) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
