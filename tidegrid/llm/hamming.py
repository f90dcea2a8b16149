"""Operator 10: exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, each with a table from value to rows. A query looks up all values
within radius r of its own segments, for r = 0, 1, ...: codes within distance m(r+1)-1 differ by at most r in
one of the m segments, so all of them have been seen after radius r. It stops once the kth verified distance
is covered that way. Codes of vectors are the signs of their components.

Rows are written to the shared folder in shards of about ``SHARD_ROWS``. Queries, in blocks of about
``QUERY_ROWS``, are dealt to every shard: a task reads the shard, makes its tables, and sends its queries
through them in batches; the k best of every shard are merged per query. Rows never move twice. Equal codes
are one entry of the tables, and at most ``CANDIDATES`` of them are looked at together, so neither a code
nor a segment that many rows share makes a task large. The values at a radius are reached by flipping bits while these are fewer than the
values that occur, and picked among these beyond, so a radius never costs more than the codes there are. Every row is
indexed; results are exact in Hamming distance.

Defined cases: null vectors and codes are neither found nor queried; NaN and null components count as 0, and
so as bit 0; vectors shorter than the longest are filled up with bits 0; ties of distance go to the smaller
id; null ids are neither found nor queried; a row is not a neighbour of itself (of its id); rows that repeat an id are
found once each; of a query id that occurs in several rows, what all of them find is ranked together, so a row may be
there once for each; fewer than k rows give fewer results; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.shared import blocks, in_python, shared_dir

SHARD_ROWS, QUERY_ROWS = 1 << 17, 1 << 9
#: Pairs of a query and a code that are looked at together, in some 50 MB.
CANDIDATES = 1 << 19
#: Tasks of a search; beyond, a task takes several pairs of a shard and a block of queries in turn.
MOST_TASKS = 20_000
SEGMENT = 16


def sign_code(vector: Column, words: int = 1) -> Column:
    """64-bit words of the signs of an array: bit i of the code is 1 where component i is over 0."""

    def word(w: int) -> Column:
        part = F.slice(vector, w * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(vector.isNotNull(), F.array(*(word(w) for w in range(words))))


class MultiIndex:
    """Tables of the segments of the distinct codes among uint64 of n x words, with the ids of each code in order."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, *codes.T))
        codes, self.ids = codes[order], ids[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        self.first, self.last = at, np.append(at[1:], len(codes))
        self.segments = np.ascontiguousarray(codes[at]).view(np.uint16)
        self.rows, self.starts, self.occupied = [], [], []
        for s in range(self.segments.shape[1]):
            self.rows.append(np.argsort(self.segments[:, s], kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(self.segments[:, s], minlength=1 << SEGMENT))]))
            self.occupied.append(np.unique(self.segments[:, s]))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest rows of each query, whose own id is left out."""
        found = _Nearest(self, np.ascontiguousarray(queries).view(np.uint16), own_ids, k)
        n, m = self.segments.shape
        active = np.arange(len(queries))
        for r in range(SEGMENT + 1):
            if not len(active) or not n:
                break
            for s in range(m):
                for part, values in self._values_at(s, found.own[active, s], r):
                    low, counts = self.starts[s][values], self.starts[s][values + 1] - self.starts[s][values]
                    some = np.flatnonzero(counts)
                    for a, b in blocks(counts[some].tolist(), CANDIDATES):
                        own = some[a:b]
                        size = counts[own]
                        row = self.rows[s][np.repeat(low[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                        found.see(np.repeat(active[part[own]], size), row, r, s)
            active = active[found.kth()[active] > m * (r + 1) - 1]
        return found.result()

    def _values_at(self, s: int, own: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the query, value) of the values of segment ``s`` at distance ``r`` from each query's, in pieces.

        They are reached by flipping bits, or picked among the values that occur, whichever are fewer.
        """
        flips, occupied = comb(SEGMENT, r), self.occupied[s]
        masks = np.array([sum(1 << f for f in c) for c in combinations(range(SEGMENT), r)], np.uint16) if flips <= len(occupied) else None
        step = max(1, CANDIDATES // min(flips, len(occupied)) if masks is not None else CANDIDATES // max(1, len(occupied)))
        for at in range(0, len(own), step):
            part = own[at : at + step, None]
            if masks is not None:
                yield np.repeat(np.arange(at, at + len(part)), flips), (part ^ masks).reshape(-1).astype(np.int64)
            else:
                q, v = np.nonzero(np.bitwise_count(part ^ occupied) == r)
                yield at + q, occupied[v].astype(np.int64)


class _Nearest:
    """The nearest codes of each query so far."""

    def __init__(self, index: MultiIndex, own: np.ndarray, own_ids: np.ndarray, k: int):
        self.index, self.own, self.own_ids, self.k = index, own, own_ids, k
        self.bits = SEGMENT * own.shape[1]
        self.seen = np.zeros((len(own), self.bits + 1), np.int64)  # rows of each distance
        self.bound = np.full(len(own), self.bits)  # distances beyond are of no use
        self.kept = [(np.zeros(0, np.int64),) * 4]
        self.size = 0

    def kth(self) -> np.ndarray:
        """Distance of the kth row of each query, one more than the bits where fewer rows were seen."""
        reached = np.cumsum(self.seen, axis=1) >= self.k
        return np.where(reached.any(axis=1), reached.argmax(axis=1), self.bits + 1)

    def see(self, q: np.ndarray, code: np.ndarray, r: int, s: int) -> None:
        """Codes that segment ``s`` finds within ``r``; each counts once, at the first of its nearest segments."""
        apart = np.bitwise_count(self.own[q] ^ self.index.segments[code])
        use = (apart[:, :s] > r).all(axis=1) & (apart[:, s + 1 :] >= r).all(axis=1)
        self._keep(q[use], code[use], apart[use].sum(axis=1, dtype=np.int64))

    def _keep(self, q: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
        near = distance <= self.bound[q]
        q, code, distance = q[near], code[near], distance[near]
        first, last = self.index.first[code], self.index.last[code]
        own = self.own_ids[q]
        low, high = _bounds(self.index.ids, first, last, own)
        others = last - first - (high - low)
        some = others > 0
        np.add.at(self.seen, (q[some], distance[some]), np.minimum(others[some], self.k))
        least = self.index.ids[np.where(low > first, first, np.minimum(high, len(self.index.ids) - 1))]
        self.kept.append((q[some], code[some], distance[some], least[some]))
        self.size += int(some.sum())
        if self.size > CANDIDATES:
            self._prune()

    def _prune(self) -> None:
        """Keep the k best codes of each query: the k best rows are among theirs."""
        self.bound = np.minimum(self.bound, self.kth())
        q, code, distance, least = (np.concatenate(x) for x in zip(*self.kept))
        near = distance <= self.bound[q]
        q, code, distance, least = q[near], code[near], distance[near], least[near]
        order = np.lexsort((least, distance, q))
        q = q[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.kept = [(q[best], *(x[order][best] for x in (code, distance, least)))]
        self.size = 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._prune()
        q, code, distance, _ = self.kept[0]
        first, last = self.index.first[code], self.index.last[code]
        low, high = _bounds(self.index.ids, first, last, self.own_ids[q])
        counts = np.minimum(last - first - (high - low), self.k)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(first, counts) + nth
        place += np.where(place >= np.repeat(low, counts), np.repeat(high - low, counts), 0)
        q, ids, distance = np.repeat(q, counts), self.index.ids[place], np.repeat(distance, counts)
        order = np.lexsort((ids, distance, q))
        q, ids, distance = q[order], ids[order], distance[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[best], ids[best], distance[best]


def _bounds(ids: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places low..high-1 of an id within first..last-1, where ids are in order; by halving all ranges at once."""
    out = []
    for beyond in (False, True):
        a, b = first.copy(), last.copy()
        while (open_ := a < b).any():
            middle = (a + b) // 2
            at = ids[np.minimum(middle, len(ids) - 1)]
            before = open_ & ((at <= own) if beyond else (at < own))
            a = np.where(before, middle + 1, a)
            b = np.where(open_ & ~before, middle, b)
        out.append(a)
    return out[0], out[1]


_held: dict[str, MultiIndex] = {}


def _read(folder: str, words: int) -> MultiIndex | None:
    """The tables of a shard, of which a worker holds the last one."""
    if folder not in _held:
        _held.clear()
        fs, path = pafs.FileSystem.from_uri(folder)
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return None
        data = pq.ParquetDataset(path, filesystem=fs, partitioning=None).read(columns=["id", "code"]).to_pandas()
        _held[folder] = MultiIndex(_codes(data["code"], words), data["id"].to_numpy())
    return _held[folder]


def _codes(arrays, words: int) -> np.ndarray:
    """uint64 of n x words; shorter codes are filled up with zeros."""
    return np.array([np.pad(np.asarray(c, np.int64), (0, words - len(c))) for c in arrays], np.int64).reshape(-1, words).view(np.uint64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, distance) of the k rows nearest to each query; both tables have (id, code array<long>)."""
    rows, queries = (df.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("code")).where("id IS NOT NULL AND code IS NOT NULL") for df in (rows, queries))
    (n, widest), (asked, widest_asked) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("code")), F.lit(1))).first() for df in (rows, queries))
    words, shards, parts = max(1, widest, widest_asked), max(1, -(-n // shard_rows)), max(1, -(-asked // query_rows))
    folder = shared_dir(rows.sparkSession)
    of_row = F.pmod(F.xxhash64("id", "code", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    rows.select("id", "code", of_row).repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    of_query = F.pmod(F.xxhash64("id", "code", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    dealt = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), of_query, "id", "code")
    dealt = dealt.repartition(min(shards * parts, MOST_TASKS), "shard", "part").sortWithinPartitions("shard", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, block in batch.groupby("shard"):
                index = _read(f"{folder}/shard={shard}", words)
                if index is not None:
                    own = block["id"].to_numpy()
                    q, ids, distance = index.search(_codes(block["code"], words), own, k)
                    yield pd.DataFrame({"query_id": own[q], "id": ids, "distance": distance})

    found = in_python(dealt, run, "query_id long, id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")
