"""Operator 11: near-duplicate vectors by an exact metric range join.

Vectors of unit length are points of a metric space: cosine c is the distance sqrt(2 - 2c). Pivots divide the
points into cells, each point to its nearest pivot, and a cell into rings of about the join's radius around its
pivot. A ring is dealt by hash into blocks of about ``BLOCK`` points, and a task owns one block. Every pair of
blocks has one that visits the other, so a point goes to its own block and, as a visitor, to those blocks in which
the triangle inequality leaves room for a partner:

- distances to the pivot of the visited cell differ by the radius at most, so rings apart by two or more don't meet;
- a partner in another cell lies beyond the plane half-way between both pivots, so a point farther from that plane
  than the radius stays away.

Points within half the radius of their pivot, the core of a cell, all link with each other: they are counted, not
compared, so a group of near copies that holds a third of all rows costs no more than any other rows. Equal vectors
are one point with a weight. Blocks are joined in tasks of their own: the members are held, visitors stream past in
batches, and what comes out is a count for each point that has links and enough links to keep what is connected
connected, never all pairs. Products are made in single precision with a margin, and those near the threshold are
made again in double precision.

Pivots are chosen from a sample of about ``SAMPLE`` points by hash: first those with most neighbours within half the
radius, then such as lie far from all chosen. They only decide how much is compared; results are exact.

Where points have no groups at all, as random ones in many dimensions, no bound separates cells: then every
point visits half of all blocks, which costs what a blocked comparison of all pairs costs.

Defined cases: null and zero vectors, and vectors with null or non-finite components, link with nothing; vectors
shorter than the longest are filled up with zeros; rows that repeat an id are vectors of their own, and count for
each other; rows with a null id take part and name no component, unless all its ids are null; components reach over
links at any distance; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected
from tidegrid.llm.shared import discard, in_python, saved

#: Points of a block, at most twice as many by chance; a task holds one, in some 12 MB for 64 components.
BLOCK = 8192
SAMPLE, LEAST_PIVOTS, MOST_PIVOTS = 4096, 8, 1024
#: Products that are looked at together.
PRODUCTS = 1 << 21
#: More than what rounding can move a distance by, and the least width of a ring.
_SLACK, _LEAST_RING = 1e-7, 1 / 32


def _points(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, point): point is the vector of unit length, null where it links with nothing; node its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = np.zeros((len(batch), width))
            for i, v in enumerate(batch["vector"]):
                if v is not None:
                    whole[i, : len(v)] = np.asarray(v, float)  # nulls become NaN
            largest = np.abs(whole).max(axis=1, initial=0.0)
            valid = np.isfinite(largest) & (largest > 0)
            scaled = whole[valid] / largest[valid, None]
            unit = np.zeros_like(whole)
            unit[valid] = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
            digests = [hashlib.blake2b((w + 0.0).tobytes(), digest_size=16).digest() if ok else None for w, ok in zip(whole, valid)]
            yield pd.DataFrame({"id": batch["id"], "node": digests, "point": [u if ok else None for u, ok in zip(unit, valid)]})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return in_python(rows, run, "id long, node binary, point array<double>")


def choose_pivots(sample: np.ndarray, count: int, radius: float) -> np.ndarray:
    """``count`` rows of the sample or fewer: hearts of dense groups first, then rows far from those chosen."""
    if not len(sample):
        return sample
    single = sample.astype(np.float32)
    near = single @ single.T >= 1 - (radius / 2) ** 2 / 2
    free, sizes = np.ones(len(sample), bool), near.sum(axis=1)
    chosen: list[int] = []
    while len(chosen) < count:
        best = int((sizes * free).argmax())
        if sizes[best] * free[best] < 3:
            break
        chosen.append(best)
        taken = near[best] & free
        free &= ~taken
        sizes -= near[:, taken].sum(axis=1)
    closest = single @ single[chosen].T if chosen else np.full((len(sample), 1), -2, np.float32)
    closest = closest.max(axis=1)
    while len(chosen) < min(count, len(sample)):
        best = int(closest.argmin())
        if chosen and closest[best] > 1 - 1e-6:
            break
        chosen.append(best)
        closest = np.maximum(closest, single @ single[best])
    return sample[chosen]


@dataclass
class Cells:
    """Pivots, and the blocks of each ring of each cell: numbers ``first[cell, ring]`` and the ``count`` from there on."""

    pivots: np.ndarray
    radius: float
    first: np.ndarray | None = None
    count: np.ndarray | None = None
    home: np.ndarray | None = None  # cell of each block
    ring: np.ndarray | None = None

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (points @ self.pivots.T)))

    def rings(self, distances: np.ndarray) -> np.ndarray:
        """0 for the core; rings that differ by two or more are farther apart than the radius."""
        core = self.radius / 2 - _SLACK
        width = max(self.radius + 2 * _SLACK, _LEAST_RING)
        return np.where(distances <= core, 0, 1 + np.floor(np.maximum(0.0, distances - core) / width)).astype(np.int64)

    @property
    def most_rings(self) -> int:
        return int(self.rings(np.array([2.0]))[0]) + 1

    def dealt(self, sizes: dict[tuple[int, int], int], block: int) -> Cells:
        """With blocks for these numbers of points by (cell, ring)."""
        count = np.zeros((len(self.pivots), self.most_rings), np.int64)
        for (cell, ring), n in sizes.items():
            count[cell, ring] = -(-n // block)
        first = (np.cumsum(count) - count.reshape(-1)).reshape(count.shape)
        cell, ring = np.divmod(np.repeat(np.arange(count.size), count.reshape(-1)), self.most_rings)
        return Cells(self.pivots, self.radius, first, count, cell, ring)

    def visits(self, points: np.ndarray, cell: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the point, block) of every visit."""
        distances = self.distances(points)
        rings = self.rings(distances)
        n = np.arange(len(points))
        between = self.distances(self.pivots)[cell]
        gap = distances**2 - distances[n, cell][:, None] ** 2
        reach = gap <= 2 * between * (self.radius + _SLACK) + _SLACK
        reach[n, cell] = True
        low, high = rings[:, self.home] - 1, rings[:, self.home] + 1
        meets = reach[:, self.home] & (low <= self.ring) & (self.ring <= high)
        # The core of a cell is counted, not compared.
        meets &= ~((self.home == cell[:, None]) & (self.ring == 0) & (rings[n, cell] == 0)[:, None])
        others = np.arange(len(self.home))
        meets &= ((others + block[:, None]) % 2 == 1) == (block[:, None] < others)
        meets[n, block] = False
        return np.nonzero(meets)


def _shares(node: pd.Series, salts: np.ndarray) -> np.ndarray:
    """A number under ``salts`` of each digest."""
    return np.array([int.from_bytes(x[:8], "little") % int(s) for x, s in zip(node, salts)], np.int64)


class _Forest:
    """Members of a block that links have joined; each set is named by its least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join members a[i] and b[i]."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


class _Block:
    """The members of a task's block, and what its visitors told of them."""

    def __init__(self, members: pd.DataFrame, threshold: float, compare_own: bool):
        self.nodes = members["node"].to_numpy()
        self.points = np.stack(members["point"].to_numpy())
        self.single = self.points.astype(np.float32)
        self.weights = members["copies"].to_numpy(float)
        self.links = np.zeros(len(members))
        self.forest, self.threshold = _Forest(len(members)), threshold
        self.margin = (self.points.shape[1] + 16) * 2.0**-22
        if compare_own:
            self.meet(self.points, self.weights, own=True)

    def meet(self, points: np.ndarray, weights: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(links of each visitor, one member that it links with, or -1); members count their visitors."""
        links, partner = np.zeros(len(points)), np.full(len(points), -1)
        step = max(1, PRODUCTS // len(self.points))
        for at in range(0, len(points), step):
            part = points[at : at + step]
            products = part.astype(np.float32) @ self.single.T
            v, m = np.nonzero(products >= self.threshold - self.margin)
            close = products[v, m] < self.threshold + self.margin
            sure = ~close
            sure[close] = (part[v[close]] * self.points[m[close]]).sum(axis=1) >= self.threshold
            v, m = v[sure], m[sure]
            if own:
                other = v + at != m
                v, m = v[other], m[other]
            links[at : at + step] += np.bincount(v, self.weights[m], len(part))
            if not own:
                self.links += np.bincount(m, weights[at + v], len(self.points))
            if len(v):
                first = np.ones(len(v), bool)
                first[1:] = v[1:] != v[:-1]
                partner[at + v[first]] = m[first]
                self.forest.join(m, partner[at + v])
                if own:
                    self.forest.join(m, at + v)
        if own:
            self.links += links
        return links, partner

    def result(self) -> pd.DataFrame:
        """Links of the members so far, and for each joined one the member that names its set."""
        joined = self.forest.root != np.arange(len(self.nodes))
        some = (self.links > 0) | joined
        return _counted(self.nodes[some], self.links[some], np.where(joined, self.nodes[self.forest.root], None)[some])


def _counted(nodes: np.ndarray, links: np.ndarray, to: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": nodes, "links": links.astype(np.int64), "v": to})


def _joined(dealt: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """(u, links, v) of the tasks: counts to be added up by u, and links u - v that keep connected what is."""

    def ready(number: int, members: list[pd.DataFrame]) -> _Block | None:
        return _Block(pd.concat(members), threshold, cells.ring[number] > 0) if members else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, own, members = None, -1, []
        for batch in batches:
            for number, part in batch.groupby("block", sort=False):
                if number != own:
                    if block := block or ready(own, members):
                        yield block.result()
                    block, own, members = None, number, []
                home, visitors = part[~part["visitor"]], part[part["visitor"]]
                if len(home):
                    members.append(home)
                if len(visitors) and (block := block or ready(own, members)):
                    links, partner = block.meet(np.stack(visitors["point"].to_numpy()), visitors["copies"].to_numpy(float))
                    some = links > 0
                    yield _counted(visitors["node"].to_numpy()[some], links[some], block.nodes[partner[some]])
        if block := block or ready(own, members):
            yield block.result()

    return in_python(dealt, run, "u binary, links long, v binary")


def _placed(points: DataFrame, cells: Cells) -> DataFrame:
    """Points with their cell and ring."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                distances = cells.distances(np.stack(batch["point"].to_numpy()))
                cell = distances.argmin(axis=1)
                yield batch.assign(cell=cell, ring=cells.rings(distances[np.arange(len(batch)), cell]))

    return in_python(points, run, "node binary, id long, copies long, point array<double>, cell int, ring int")


def _dealt(placed: DataFrame, cells: Cells) -> DataFrame:
    """(block, visitor, node, copies, point): every point in its block, and once for each visit; members first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, ring = batch["cell"].to_numpy(), batch["ring"].to_numpy()
                block = cells.first[cell, ring] + _shares(batch["node"], cells.count[cell, ring])
                own = batch[["node", "copies", "point"]]
                yield own.assign(block=block, visitor=False)
                who, to = cells.visits(np.stack(batch["point"].to_numpy()), cell, block)
                for at in range(0, len(who), 2000):
                    yield own.iloc[who[at : at + 2000]].assign(block=to[at : at + 2000], visitor=True)

    rows = in_python(placed, run, "node binary, copies long, point array<double>, block int, visitor boolean")
    return rows.repartition(max(1, len(cells.home)), "block").sortWithinPartitions("block", "visitor")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK, sample: int = SAMPLE, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are vectors with cosine ``threshold`` or more.

    ``component_id`` is the least id that links reach, and a row is kept if it is its own.
    """
    width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    signed = saved(_points(vectors, max(1, width), id_col, vector_col))
    points = saved(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("point").alias("point")))
    n = points.count()
    chosen = points.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // sample))) == 0).orderBy("node").select("point").collect()  # about ``sample`` rows
    wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, n // block))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = Cells(choose_pivots(np.array([r["point"] for r in chosen]), wanted, radius), radius)
    if not len(cells.pivots):
        return _named(signed, signed.sparkSession.createDataFrame([], "node binary, n_links long, component_id long"), id_col)
    placed = saved(_placed(points, cells))
    sizes = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("node").alias("node")).collect()  # a few rows a pivot
    cells = cells.dealt({(r["cell"], r["ring"]): r["n"] for r in sizes}, block)
    found = saved(_joined(_dealt(placed, cells), cells, threshold))
    cores = placed.sparkSession.createDataFrame([(r["cell"], r["copies"], r["node"]) for r in sizes if r["ring"] == 0], "cell int, core_copies long, v binary")
    core = placed.where("ring = 0").join(F.broadcast(cores), "cell")
    counted = found.select("u", "links").union(core.select("node", F.col("core_copies") - F.col("copies"))).groupBy("u").agg(F.sum("links").alias("links"))
    label = connected(found.where("v IS NOT NULL").select("u", "v").union(core.select("node", "v")))
    of_point = points.select("node", "id", "copies").join(counted.withColumnRenamed("u", "node"), "node", "left").join(label, "node", "left")
    of_point = saved(of_point.select("node", "id", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    named = of_point.groupBy("component").agg(F.min("id").alias("component_id"))
    named = saved(of_point.join(named, "component").select("node", "n_links", "component_id"))
    for done in (points, placed, found, of_point):
        discard(done)
    return _named(signed, named, id_col)


def _named(signed: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """Links and component of every row; one without a point is alone."""
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = signed.join(named, "node", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
