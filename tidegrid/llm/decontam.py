"""Operator 3: benchmark decontamination by greedy string tiling.

Every window of ``least_match`` words of a benchmark item is a seed, found in documents by its Karp-Rabin
hash. Seeds that join on a diagonal grow to maximal matches; the longest match is marked again and again,
matches that overlap marked words are cut back, and what is left below the least match is dropped. The
share of an item's words under tiles is its coverage, so passages in another order count in full.

Items are written to the shared folder in slices of about ``SLICE_BYTES``, so neither the driver nor a task holds
the benchmark. Documents are read and hashed once, whatever its size: a task holds about ``HELD_CHARS`` of them
while slice after slice passes. They are neither shuffled nor gathered, so words, lines and passages of any
frequency cost only their own length. Seeds are joined ``SEEDS`` at a time.

Defined cases: an item of fewer words than the least match is matched as a whole; null or empty items and
documents match nothing; ties of length go to the earlier place in the item, then in the document; repeated
documents and items give a row each; documents of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import blocks, in_python, shared_dir
from tidegrid.llm.words import Words, windows, words_of

SLICE_BYTES = 8 << 20
BLOCK_CHARS = 1 << 19
#: Text that a task holds while it goes through several slices.
HELD_CHARS = 1 << 24
#: Pairs of equal seeds that are looked at together, in some 50 MB.
SEEDS = 1 << 19
_FILTER_BITS = 22


def joined_runs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(item, place in item, place in document, seeds) of maximal runs, from runs of which some continue others."""
    k, i, j, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((i, j - i, k))
    k, i, j, n = k[order], i[order], j[order], n[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1] + n[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1])
    at = np.flatnonzero(new)
    return k[at], i[at], j[at], np.add.reduceat(n, at) if len(at) else n


def tile(item_words: int, doc_words: int, i: np.ndarray, j: np.ndarray, lengths: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place in item, place in document, length) of the tiles, longest first, from the maximal matches."""
    queue = [(-int(n), int(a), int(b)) for n, a, b in zip(lengths, i, j)]
    heapq.heapify(queue)
    free_item, free_doc, left = np.ones(item_words, bool), np.ones(doc_words, bool), item_words
    tiles = []
    while queue and left >= width:
        n, a, b = heapq.heappop(queue)
        n = -n
        free = free_item[a : a + n] & free_doc[b : b + n]
        if free.all():
            tiles.append((a, b, n))
            free_item[a : a + n] = free_doc[b : b + n] = False
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for start, stop in zip(edges[::2], edges[1::2]):
            if stop - start >= width:
                heapq.heappush(queue, (-int(stop - start), a + int(start), b + int(start)))
    return tiles


@dataclass
class _Seeds:
    """Windows of the items, sorted by hash; those of one width."""

    width: int
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    near: np.ndarray  # whether any hash has these leading bits

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Which windows may be seeds of some item."""
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[place] == hashes[maybe]]


class Benchmark:
    def __init__(self, ids: list, texts: list[str | None], least_match: int):
        words = words_of(texts)
        self.ids, self.words, self.first = ids, words.hashes, words.first[:-1]
        self.items = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.seeds = []
        for width in sorted({min(least_match, len(w)) for w in self.items if len(w)}):
            own = [(k, windows(w, width)) for k, w in enumerate(self.items) if min(least_match, len(w)) == width]
            hashes = np.concatenate([h for _, h in own])
            item, at = np.repeat([k for k, _ in own], [len(h) for _, h in own]), np.concatenate([np.arange(len(h)) for _, h in own])
            order = np.argsort(hashes, kind="stable")
            near = np.zeros(1 << _FILTER_BITS, bool)
            near[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds.append(_Seeds(width, hashes[order], item[order], at[order], near))

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(number of the text, number of the item, tiles) of every text and item that share a seed."""
        return self.matches_of(words_of(texts))

    def matches_of(self, words: Words) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        for seeds in self.seeds:
            hashes = windows(words.hashes, seeds.width)
            inside = words.text[: len(hashes)] == words.text[seeds.width - 1 :] if len(hashes) else np.zeros(0, bool)
            found = seeds.find(hashes)
            found = found[inside[found]]
            for text in np.unique(words.text[found]):
                start, stop = words.first[text], words.first[text + 1]
                places = found[(found >= start) & (found < stop)]
                runs = [(np.zeros(0, np.int64),) * 4]
                low, high = (np.searchsorted(seeds.hashes, hashes[places], side) for side in ("left", "right"))
                for a, b in blocks((high - low).tolist(), SEEDS):
                    runs.append(self._runs(seeds, words.hashes[start:stop], places[a:b] - start, low[a:b], high[a:b] - low[a:b]))
                item, i, j, n = joined_runs(runs)
                cuts = [0, *(np.flatnonzero(np.diff(item)) + 1).tolist(), len(item)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        k = int(item[a])
                        yield int(text), k, tile(len(self.items[k]), int(stop - start), i[a:b], j[a:b], n[a:b] + seeds.width - 1, seeds.width)

    def _runs(self, seeds: _Seeds, doc: np.ndarray, places: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of the seeds at these places of a document, whose entries are low..low+counts-1; words are compared."""
        entry = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        item, i, j = seeds.item[entry].astype(np.int64), seeds.at[entry], np.repeat(places, counts)
        same = np.ones(len(j), bool)
        for d in range(seeds.width):
            same &= self.words[self.first[item] + i + d] == doc[j + d]
        item, i, j = item[same], i[same], j[same]
        return joined_runs([(item, i, j, np.ones(len(i), np.int64))])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_match: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(id, item id, item_words, covered_words, coverage, tiles) of documents that cover ``threshold`` of an item.

    A tile is (place in the item, place in the document, length), in words from 0.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    items = items.groupBy("item", "text").agg(F.count("*").alias("copies"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    folder = shared_dir(docs.sparkSession)
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)).cast("int"))
    dealt.repartition(slices, "slice").sortWithinPartitions("item", "text").write.partitionBy("slice").parquet(folder)
    out = _scan(docs, folder, slices, least_match, threshold, id_col, text_col)
    repeated = out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    return repeated.withColumnsRenamed({"id": id_col, "item": item_col})


_held: dict[tuple[str, int], Benchmark] = {}


def _read(folder: str, least_match: int) -> Benchmark:
    """The slice in this folder; a worker holds the one it used last."""
    if (folder, least_match) not in _held:
        _held.clear()
        fs, path = pafs.FileSystem.from_uri(folder)
        rows = {"item": [], "text": [], "copies": []}
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            rows = pq.ParquetDataset(path, filesystem=fs, partitioning=None).read(columns=list(rows)).to_pydict()
        _held[folder, least_match] = Benchmark(list(zip(rows["item"], rows["copies"])), rows["text"], least_match)
    return _held[folder, least_match]


def _together(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of consecutive batches that hold ``most`` characters or a little more."""
    ids, texts, held = [], [], 0
    for batch in batches:
        ids += batch["id"].tolist()
        texts += batch["text"].tolist()
        held += sum(len(t or "") for t in batch["text"])
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _scan(docs: DataFrame, folder: str, slices: int, least_match: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _together(batches, HELD_CHARS if slices > 1 else 0):
            hashed = ((a, words_of(texts[a:b])) for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS))
            if slices > 1:
                hashed = list(hashed)
            for k in range(slices):
                yield found(_read(f"{folder}/slice={k}", least_match), ids, hashed)

    def found(index: Benchmark, ids: list, hashed: Iterable[tuple[int, Words]]) -> pd.DataFrame:
        rows = []
        for first, words in hashed:
            for t, k, tiles in index.matches_of(words):
                covered, total = sum(n for *_, n in tiles), len(index.items[k])
                if covered >= threshold * total:
                    rows.append((ids[first + t], *index.ids[k], total, covered, covered / total, [{"item_at": x, "doc_at": y, "length": n} for x, y, n in tiles]))
        out = pd.DataFrame(rows, columns=["id", "item", "copies", "item_words", "covered_words", "coverage", "tiles"])
        for c in ("id", "item"):
            out[c] = out[c].astype("Int64")
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, copies long, item_words int, covered_words int, coverage double, tiles array<struct<item_at:int,doc_at:int,length:int>>"
    return in_python(rows, run, schema)
