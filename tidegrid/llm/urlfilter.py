"""Operator 5: URL filter over a sorted digest array.

Rules (host, path, verdict) are kept under the 64-bit xxhash of ``host + path``: a sorted array of keys and
the full strings they stand for, in one file that workers map into memory. A URL is probed with every host
suffix that starts at a label and every path prefix as long as some rule's path, by vectorised binary
search; a hit counts only if the stored string is equal, so collisions of keys cannot matter. The longest
rule that fits gives the verdict; where none fits, ``default`` does.

An index of up to ``MOST_INDEX_BYTES`` is broadcast. A larger one is cut into arrays by ranges of keys, and each
is built, mapped and probed in the task of its range, to which the distinct probes of that range go.

Defined cases: a null URL, or one without ``://``, has empty host and path, so no rule fits; of rules equally
long the one with the longer host wins; of repeated rules with different verdicts ``block`` wins; an empty
rule list gives ``default`` everywhere; repeated rows are judged alike; columns other than those named are
not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import in_python, saved

MOST_INDEX_BYTES = 64 << 20
#: Probes that one range of keys should have at most, when the index is cut by ranges.
PROBES = 1 << 20
#: Fixed value: the seed of Spark's own xxhash64, which makes the same keys.
SEED = 42
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), SEED)


class DigestArray:
    """Sorted keys with their strings and verdicts, laid out as one block of bytes that can be mapped.

    Layout: counts, keys (n x 8), offsets of strings (n+1 x 8), lengths of hosts (n x 4), the lengths that paths have
    (each once, x 4), blocked flags (n), strings. Entries with one key are neighbours; all are looked at.
    """

    def __init__(self, data: np.ndarray):
        n, k = (int(x) for x in data[:16].view(np.uint64))
        at = 16
        self.keys, at = data[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.offsets, at = data[at : at + 8 * (n + 1)].view(np.uint64), at + 8 * (n + 1)
        self.host_length, at = data[at : at + 4 * n].view(np.uint32), at + 4 * n
        self.path_lengths, at = data[at : at + 4 * k].view(np.uint32).tolist(), at + 4 * k
        self.blocked, at = data[at : at + n], at + n
        self.strings = data[at:]

    @staticmethod
    def build(rules: list[tuple[str, str, str]]) -> bytes:
        verdicts: dict[tuple[str, str], bool] = {}
        for host, path, verdict in rules:
            host = host.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
            verdicts[host, path] = verdicts.get((host, path), False) or verdict == "block"
        entries = sorted((digest(h + p), h, p, b) for (h, p), b in verdicts.items())
        strings, lengths = [(h + p).encode() for _, h, p, _ in entries], sorted({len(p) for _, _, p, _ in entries})
        parts = (
            np.array([len(entries), len(lengths)], np.uint64), np.array([k for k, *_ in entries], np.uint64),
            np.cumsum([0, *map(len, strings)]).astype(np.uint64), np.array([len(h.encode()) for _, h, _, _ in entries], np.uint32),
            np.array(lengths, np.uint32), np.array([b for *_, b in entries], np.uint8),
        )
        return b"".join([*(p.tobytes() for p in parts), *strings])

    def __len__(self) -> int:
        return len(self.keys)

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, keys: np.ndarray, texts: list[str], host_lengths: np.ndarray) -> np.ndarray:
        """Entry of each probe, or -1; ``texts`` are the probes' strings."""
        out = np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        live = np.flatnonzero(at < len(self.keys))
        while len(live):
            live = live[self.keys[at[live]] == keys[live]]
            equal = np.array([self.string(at[i]) == texts[i].encode("utf-8", "replace") and self.host_length[at[i]] == host_lengths[i] for i in live], bool)
            out[live[equal]] = at[live[equal]]
            live = live[~equal]
            at[live] += 1
            live = live[at[live] < len(self.keys)]
        return out


def probes(host: str, path: str, path_lengths: list[int]) -> Iterator[tuple[str, str]]:
    """(host suffix, path prefix) that a rule could have; at most labels x path lengths."""
    at = 0
    while True:
        for n in path_lengths:
            if n <= len(path):
                yield host[at:], path[:n]
        at = host.find(".", at) + 1
        if not at:
            return


_mapped: dict[str, DigestArray] = {}


def _map(block: bytes, keep: bool = True) -> DigestArray:
    """The index mapped from a file of this worker's own temporary folder; ``keep``: written once per process."""
    name = xxhash.xxh128_hexdigest(block)
    if name in _mapped:
        return _mapped[name]
    handle, path = tempfile.mkstemp(prefix="urls-")
    with os.fdopen(handle, "wb") as f:
        f.write(block)
    index = DigestArray(np.memmap(path, np.uint8, "r"))
    os.unlink(path)
    if keep:
        _mapped[name] = index
    return index


def judge_array(hosts: list[str], paths: list[str], index: DigestArray, default: str) -> tuple[list[str | None], list[str]]:
    lengths = index.path_lengths
    owner, texts, host_lengths = [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            for h, p in probes(host, path, lengths):
                owner.append(i)
                texts.append(h + p)
                host_lengths.append(len(h.encode("utf-8", "replace")))
    found = index.find(np.array([digest(t) for t in texts], np.uint64), texts, np.array(host_lengths))
    rules: list[str | None] = [None] * len(hosts)
    verdicts, best = [default] * len(hosts), [(-1, -1)] * len(hosts)
    for k in np.flatnonzero(found >= 0):
        i, rank = owner[k], (len(texts[k]), host_lengths[k])
        if rank > best[i]:
            best[i], rules[i], verdicts[i] = rank, texts[k], "block" if index.blocked[found[k]] else "allow"
    return rules, verdicts


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", most_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """The kept columns, host, path, rule (host and path of the rule that fits, or null) and verdict of every URL.

    ``rules`` are (host, path, verdict) as a list, or a table with these columns for lists of any size.
    """
    parsed = urls.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 21), F.lit(0))).first()[0]
        if size > most_index_bytes:
            return _judge_by_ranges(parsed, rules, keep, default, max(1, -(-size // max(1, most_index_bytes))))
        rules = [(r["host"], r["path"], r["verdict"]) for r in rules.select("host", "path", "verdict").collect()]
    shared = urls.sparkSession.sparkContext.broadcast(DigestArray.build(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _map(shared.value)
        for batch in batches:
            found, verdicts = judge_array(batch["host"].tolist(), batch["path"].tolist(), index, default)
            batch["rule"], batch["verdict"] = pd.Series(found, batch.index, object), verdicts
            yield batch

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema)
    out = in_python(parsed, run, fields + ", rule string, verdict string")
    return out.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", "verdict")


def _judge_by_ranges(parsed: DataFrame, rules: DataFrame, keep: tuple[str, ...], default: str, least_ranges: int) -> DataFrame:
    """The same with an array for each range of keys. Distinct probes are judged once, whatever number of URLs has them."""
    host = F.translate("host", ASCII_UPPER, ASCII_LOWER)
    rules = rules.select(host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocked"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # a row for each length of a path
    labels = F.split("host", r"\.")
    places = parsed.select("host", "path").where("host != ''").distinct()
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    probed = saved(places.withColumn("suffix", F.explode(suffix)).withColumn("n", F.explode(fitting)).withColumn("prefix", F.expr("substring(path, 1, n)")).drop("n"))
    distinct = probed.select("suffix", "prefix").distinct()
    ranges = max(least_ranges, -(-distinct.count() // PROBES))

    def ranged(df: DataFrame, a: str, b: str) -> DataFrame:
        high = F.shiftrightunsigned(F.xxhash64(F.concat(a, b)), 33)  # the leading 31 bits of the key
        return df.withColumn("range", F.floor(high * ranges / F.lit(1 << 31)).cast("int"))

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        index = _map(DigestArray.build([(h, p, "block" if b else "allow") for h, p, b in zip(own["host"], own["path"], own["blocked"])]), keep=False)
        texts = [a + b for a, b in zip(asked["suffix"], asked["prefix"])]
        found = index.find(np.array([digest(t) for t in texts], np.uint64), texts, np.array([len(a.encode("utf-8", "replace")) for a in asked["suffix"]], np.int64))
        hit = np.flatnonzero(found >= 0)
        out = asked[["suffix", "prefix"]].iloc[hit].copy()
        out["blocked"] = index.blocked[found[hit]].astype(bool)
        return out

    asked, own = ranged(distinct, "suffix", "prefix"), ranged(rules, "host", "path")
    hits = asked.groupBy("range").cogroup(own.groupBy("range")).applyInPandas(run, "suffix string, prefix string, blocked boolean")
    text = F.concat("suffix", "prefix")
    fit = probed.join(hits, ["suffix", "prefix"])
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), F.length("suffix").alias("h"), text.alias("rule"), "blocked")).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocked"), "block").otherwise("allow")
    return out.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
