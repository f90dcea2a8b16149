"""Operator 13: ranked lexical search by Block-Max WAND over compressed posting blocks.

Documents are indexed in shards of about ``SHARD_BYTES`` of text, each made by one task from rows as they come, so
texts are not shuffled. A shard holds for each of its terms the documents with that term, in order, in blocks of
``BLOCK`` postings: gaps and counts in bytes of 7 bits, and beside them, readable without decompression, the first and
last document and the largest impact of the block. The impact of a posting is what a term of weight 1 adds to a score.

Queries are dealt to all shards in parts of ``QUERIES``. In a shard the pointers of all lists of a query are first
moved shallowly, over the borders of blocks alone: between two borders every list stands in one block or in none, and
the largest impacts of these blocks, times weights, add up to a bound of any score there. Ranges of documents are
taken by falling bound, until the bounds fall under the kth score so far; what is left is skipped and its blocks are
never decompressed. In a range the lists are ordered by their bounds: documents that stand only in lists before the
pivot, at which the running sum of bounds reaches the kth score, cannot reach it, so blocks from the pivot on are
decompressed first, and the others only where these hold a document. The k best of every shard are merged per query.
Results are exact: a document is skipped only where its score must be under the kth.

Statistics (documents with terms, terms in all, documents holding a term) are counted over all documents. Terms are
told apart by 64-bit hashes.

Defined cases: null and empty texts hold no terms; rows with a null id count in the statistics but are not ranked;
rows that repeat an id are ranked each; equal scores go by ascending id; items without terms, or with terms that no
document holds, have no rows; a null item is not asked; rows that repeat an item id are asked as one; documents of
any length are read whole; an empty table on either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.shared import blocks, in_python, saved
from tidegrid.llm.words import terms_of

BLOCK = 128
SHARD_BYTES = 1 << 24
QUERIES = 64
BLOCK_CHARS = 1 << 19
#: Ranges that are looked at first; every further step takes twice as many.
FIRST_RANGES = 16


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of the first byte of each value and of the end): 7 bits a byte, the last one of a value under 128."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for k in range(1, 10):
        lengths += values >= np.uint64(1 << (7 * k)) if k < 9 else 0
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(starts[-1], np.uint8)
    for k in range(int(lengths.max(initial=0))):
        some = lengths > k
        part = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[starts[:-1][some] + k] = part | np.where(lengths[some] > k + 1, np.uint8(128), np.uint8(0))
    return out, starts


def unpacked(data: np.ndarray) -> np.ndarray:
    """Values of ``packed`` bytes."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(starts) else np.zeros(0, np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score for each 1 of its term's weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m.astype(np.int64))


@dataclass(frozen=True)
class Statistics:
    documents: int
    terms: int

    def m(self, n: np.ndarray) -> np.ndarray:
        """The share of a document's length in its impacts: 100 at the average."""
        return 10 + (90 * n.astype(np.int64) * self.documents) // max(1, self.terms)


def statistics(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = terms = 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                counts = np.diff(terms_of(texts[a:b]).first)
                documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
        yield pd.DataFrame({"documents": [documents], "terms": [terms]})

    sums = in_python(docs.select(F.col(text_col).alias("text")), run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Statistics(sums[0] or 0, sums[1] or 0)


class Shard:
    """Postings of some documents, gathered text by text."""

    def __init__(self, number: int, statistics: Statistics):
        self.number, self.statistics, self.size = number, statistics, 0
        self.ids, self.lengths, self.postings = [], [], []

    def add(self, ids: list, texts: list[str | None]) -> None:
        words = terms_of(texts)
        order = np.lexsort((words.hashes, words.text))
        term, text = words.hashes[order], words.text[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.postings.append((term[at].view(np.int64), (text[at] + len(self.ids)).astype(np.int32), np.diff(np.append(at, len(term))).astype(np.int32)))
        self.ids += ids
        self.lengths.append(np.diff(words.first))
        self.size += sum(len(t or "") for t in texts)

    def rows(self) -> Iterator[pd.DataFrame]:
        """Rows of the index: blocks of postings, and one of the documents themselves."""
        m = self.statistics.m(np.concatenate(self.lengths)) if self.lengths else np.zeros(0, np.int64)
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        known = np.packbits(np.array([i is not None for i in self.ids], bool)).tobytes()
        yield self._frame([None], [0], [len(ids)], [0], [0], [0], [ids.tobytes() + m.tobytes() + known])
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings)) if self.postings else (np.zeros(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        if not len(term):
            return
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        at = np.flatnonzero(place % BLOCK == 0)
        gaps = np.diff(doc, prepend=doc[:1])
        gaps[at] = 0
        data, starts = packed(np.stack([gaps, tf], axis=1).reshape(-1))
        cuts = starts[np.append(2 * at, 2 * len(term))]
        last = np.append(at[1:], len(term)) - 1
        most = np.maximum.reduceat(impact(tf, m[doc]), at)
        for a in range(0, len(at), 50_000):
            b = min(len(at), a + 50_000)
            payload = [data[i:j].tobytes() for i, j in zip(cuts[a:b], cuts[a + 1 : b + 1])]
            yield self._frame(term[at[a:b]], place[at[a:b]] // BLOCK, last[a:b] - at[a:b] + 1, most[a:b], doc[at[a:b]], doc[last[a:b]], payload)

    def _frame(self, term, block, n, most, first, last, payload) -> pd.DataFrame:
        return pd.DataFrame({"shard": self.number, "term": pd.array(term, "Int64"), "block": block, "n": n, "most": most, "first": first, "last": last, "payload": payload})


def indexed(docs: DataFrame, known: Statistics, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, saved: (shard, term, block, n, most, first, last, payload); the row of a shard without a term holds its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        shard = Shard(number, known)
        for batch in batches:
            texts, ids = batch["text"].tolist(), [None if pd.isna(i) else int(i) for i in batch["id"]]
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                shard.add(ids[a:b], texts[a:b])
                if shard.size >= shard_bytes:
                    yield from shard.rows()
                    number += 1
                    shard = Shard(number, known)
        if shard.ids:
            yield from shard.rows()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return saved(in_python(rows, run, "shard long, term long, block int, n long, most long, first int, last int, payload binary"))


class Postings:
    """The blocks of a shard that a part of the queries may need, of which each is decompressed once at most."""

    def __init__(self, found: pd.DataFrame, m: np.ndarray):
        found = found.sort_values(["term", "block"], kind="stable")
        self.first, self.last, self.n, self.most = (found[c].to_numpy(np.int64) for c in ("first", "last", "n", "most"))
        self.payload, self.m = found["payload"].tolist(), m
        terms = found["term"].to_numpy(np.int64)
        at = np.flatnonzero(np.diff(terms, prepend=terms[:1] - 1)) if len(terms) else np.zeros(0, np.int64)
        self.lists = {int(terms[a]): (int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(terms)))}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def decompress(self, numbers: np.ndarray) -> None:
        numbers = np.array([b for b in numbers.tolist() if b not in self.open], np.int64)
        if not len(numbers):
            return
        values = unpacked(np.frombuffer(b"".join(self.payload[b] for b in numbers), np.uint8)).reshape(-1, 2)
        ends = np.cumsum(self.n[numbers])
        starts = ends - self.n[numbers]
        steps = np.cumsum(values[:, 0])
        doc = steps - np.repeat(steps[starts], self.n[numbers]) + np.repeat(self.first[numbers], self.n[numbers])
        impacts = impact(values[:, 1], self.m[doc])
        for b, i, j in zip(numbers.tolist(), starts.tolist(), ends.tolist()):
            self.open[b] = doc[i:j], impacts[i:j]


class Search:
    """One query in one shard."""

    def __init__(self, postings: Postings, ids: np.ndarray, known: np.ndarray, terms: list[int], weights: list[int], k: int):
        self.postings, self.ids, self.known, self.k = postings, ids, known, k
        lists = [(*postings.lists[t], w) for t, w in zip(terms, weights) if t in postings.lists]
        self.weights = np.array([w for _, _, w in lists], np.int64)
        edges = [np.concatenate([postings.first[a:b], postings.last[a:b] + 1]) for a, b, _ in lists]
        self.edges = np.unique(np.concatenate(edges)) if edges else np.zeros(0, np.int64)
        # Shallow moves: the block in which each list stands in each range, or -1.
        self.standing = np.full((len(lists), len(self.edges)), -1)
        for i, (a, b, _) in enumerate(lists):
            at = a + np.searchsorted(postings.first[a:b], self.edges, "right") - 1
            self.standing[i] = np.where((at >= a) & (self.edges <= postings.last[np.maximum(at, a)]), at, -1)
        self.bounds = np.where(self.standing >= 0, postings.most[self.standing] if len(postings.most) else 0, 0) * self.weights[:, None]
        self.best_docs, self.best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def kth(self) -> int:
        """Least score that is of use."""
        return max(1, int(self.best_scores[-1])) if len(self.best_scores) == self.k else 1

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, best first."""
        sums = self.bounds.sum(axis=0)
        order = np.argsort(-sums, kind="stable")
        at, step = 0, FIRST_RANGES
        while at < len(order) and sums[order[at]] >= self.kth():
            some = order[at : at + step]
            self._look(some[sums[some] >= self.kth()])
            at, step = at + step, step * 2
        return self.best_docs, self.best_scores

    def _look(self, ranges: np.ndarray) -> None:
        """Score the documents of these ranges that can reach the kth score."""
        bounds = self.bounds[:, ranges]
        order = np.argsort(bounds, axis=0, kind="stable")
        from_pivot = np.zeros(bounds.shape, bool)
        np.put_along_axis(from_pivot, order, np.cumsum(np.take_along_axis(bounds, order, axis=0), axis=0) >= self.kth(), axis=0)
        stand = self.standing[:, ranges]
        docs, _ = self._postings(ranges, stand, from_pivot)
        candidates = np.unique(docs)
        holding = np.isin(ranges, self._range(candidates))
        more, scores = self._postings(ranges, stand, np.broadcast_to(holding, stand.shape))
        total = np.zeros(len(candidates), np.int64)
        place = np.minimum(np.searchsorted(candidates, more), max(0, len(candidates) - 1))
        own = candidates[place] == more if len(candidates) else np.zeros(0, bool)
        np.add.at(total, place[own], scores[own])
        use = (total >= self.kth()) & self.known[candidates]
        docs, scores = np.concatenate([self.best_docs, candidates[use]]), np.concatenate([self.best_scores, total[use]])
        best = np.lexsort((self.ids[docs], -scores))[: self.k]
        self.best_docs, self.best_scores = docs[best], scores[best]

    def _range(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, docs, "right") - 1

    def _postings(self, ranges: np.ndarray, stand: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, weighted impact) of the postings in the used lists of these ranges."""
        lists, at = np.nonzero(use & (stand >= 0))
        pairs = np.unique(np.stack([stand[lists, at], lists]), axis=1)
        self.postings.decompress(pairs[0])
        wanted = np.zeros((len(self.weights), len(self.edges)), bool)
        wanted[lists, ranges[at]] = True
        docs, scores, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, i in pairs.T.tolist():
            d, s = self.postings.open[block]
            docs.append(d)
            scores.append(s * self.weights[i])
            owner.append(np.full(len(d), i))
        docs, scores, owner = np.concatenate(docs), np.concatenate(scores), np.concatenate(owner)
        inside = wanted[owner, self._range(docs)] if len(docs) else np.zeros(0, bool)
        return docs[inside], scores[inside]


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = terms_of(batch["text"].tolist())
            yield pd.DataFrame({"item": batch["item"].to_numpy()[words.text], "term": words.hashes.view(np.int64)}).drop_duplicates()

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL")
    return in_python(rows, run, "item long, term long").distinct()


def search(index: DataFrame, known: Statistics, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", queries: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k documents of the index that score highest for each item, with a score over 0."""
    asked = saved(_asked(items, id_col, text_col))
    parts = max(1, -(-asked.select("item").distinct().count() // queries))
    holding = index.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * known.documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part")
    weighed = saved(asked.join(holding.select("term", weight.alias("weight")).where("weight > 0"), "term").select(part, "item", "term", "weight"))
    by_item = weighed.groupBy("part", "item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))  # the terms of one item
    by_part = by_item.groupBy("part").agg(F.collect_list(F.struct("item", "terms")).alias("items"))  # of about ``queries`` items
    shards = index.where("term IS NULL").select(F.col("shard").alias("of_shard"), F.col("n").alias("documents"), F.col("payload").alias("about"))
    heads = shards.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(by_part.withColumnRenamed("part", "of_part"), "of_part")
    found = index.join(weighed.select("part", "term").distinct(), "term").select("shard", "part", "term", "block", "n", "most", "first", "last", "payload")

    def run(lists: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, payload, own in zip(head["documents"], head["about"], head["items"]):
            n = int(n)
            ids, m = np.frombuffer(payload[: 8 * n], np.int64), np.frombuffer(payload[8 * n : 16 * n], np.int64)
            has_id = np.unpackbits(np.frombuffer(payload[16 * n :], np.uint8), count=n).astype(bool)
            postings = Postings(lists, m)
            for one in own:
                docs, scores = Search(postings, ids, has_id, [t["term"] for t in one["terms"]], [t["weight"] for t in one["terms"]], k).run()
                out.append(pd.DataFrame({"item": one["item"], "doc": ids[docs], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"item": [], "doc": [], "score": []}, dtype="int64")

    best = found.groupBy("shard", "part").cogroup(heads.groupBy("of_shard", "of_part")).applyInPandas(run, "item long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, queries: int = QUERIES) -> DataFrame:
    """``search`` of all items in an index made of all documents."""
    known = statistics(docs)
    return search(indexed(docs, known, shard_bytes=shard_bytes), known, items, k, queries=queries)
