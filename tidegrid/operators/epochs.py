"""Epochs: when the frame of a grid moves, and cells under frames that move.

Each new frame depends on the one before, so the anchors of a stream are found in order; only (seq, middle) of
its books take part, and the few epochs that come out are small. Everything else is set-wise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import band_frame, finite, half_float, make_hybrid
from tidegrid.operators.running import running

#: The inner part of a frame that the middle may roam, and the ratio that moves the frame of a band.
INNER_LOW, INNER_HIGH = 0.15, 0.85
TRIP_RATIO = 1.25


@dataclass(frozen=True)
class Frame:
    """Geometry that a grid starts with; a band of (up, down) shares makes it follow the price by ratio.

    A band with ``core_rows`` is hybrid: the first middle around which it can be made installs its scale, which stays.
    """

    p0: float
    tick: float
    rows: int
    tick_multiple: int = 1
    band: tuple[float, float] | None = None
    core_rows: int | None = None

    def around(self, middle: float, step: float) -> float:
        """Lowest price of the frame with this middle in its centre, on the grid of its step."""
        return round((middle - self.rows * step / 2) / step) * step

    def leaves(self, middles: np.ndarray, p0: float, step: float, anchor: float | None) -> np.ndarray:
        """Which middles move the frame: those out of its inner part, or too far from the anchor of a band in ratio."""
        if anchor is None:
            low, high = p0 + INNER_LOW * self.rows * step, p0 + INNER_HIGH * self.rows * step
        else:
            low, high = anchor / TRIP_RATIO, anchor * TRIP_RATIO
        return (middles < low) | (middles > high)


_EPOCH = ["stream", "epoch", "from_seq", "p0", "tick_multiple", "anchor"]


def epoch_table(middles: DataFrame, frame: Frame) -> DataFrame:
    """(stream, epoch, from_seq, p0, tick_multiple) of each stream's frames; ``middles`` are (stream, seq, ref).

    A band starts with the first middle around which a frame can be made; its multiple then stays.
    """
    start = middles.where(finite(F.col("ref"))).select("stream").distinct().select("stream", F.lit(0).alias("epoch"), F.lit(frame.p0).alias("p0"), F.lit(frame.tick_multiple).alias("tick_multiple"), F.lit(None).cast("double").alias("anchor"))
    first = start.select("stream", "epoch", F.lit(-1).cast("long").alias("from_seq"), "p0", "tick_multiple")
    return first.union(moves(middles, frame, start).drop("anchor"))


def moves(middles: DataFrame, frame: Frame, start: DataFrame) -> DataFrame:
    """(stream, epoch, from_seq, p0, tick_multiple, anchor) of the frames that follow ``start``, one row a stream.

    Rows arrive sorted and in pieces, so a stream is never held whole, and each move is found at once in a piece.
    """
    known = middles.where(finite(F.col("ref"))).select("stream", "seq", "ref")
    if frame.band is None:
        made = known.select("stream").distinct().select("stream", F.lit(None).cast("long").alias("start"), F.lit(None).cast("struct<p0:double,tick_multiple:int>").alias("made"))
    else:
        first = known.withColumn("made", band_frame(F.col("ref"), frame.band[0], frame.band[1], frame.tick, frame.rows)).where("made IS NOT NULL")
        first = first.groupBy("stream").agg(F.min("seq").alias("start"), F.min_by("made", "seq").alias("made"))
        made = known.select("stream").distinct().join(first, "stream", "left")
    given = known.join(made.select("stream", "start", F.col("made.p0").alias("first_p0"), F.col("made.tick_multiple").alias("first_multiple")), "stream").join(start.select("stream", "epoch", "p0", "tick_multiple", "anchor"), "stream")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = epoch = p0 = multiple = anchor = None
        begun = False
        for batch in batches:
            rows = []
            for name, part in batch.groupby("stream", sort=False):
                if not begun or name != stream:
                    now = part.iloc[0]
                    stream, begun, epoch, p0, multiple = name, True, int(now["epoch"]), float(now["p0"]), int(now["tick_multiple"])
                    anchor = None if pd.isna(now["anchor"]) else float(now["anchor"])
                seqs, refs = part["seq"].to_numpy(), part["ref"].to_numpy()
                at = 0
                if frame.band is not None and anchor is None:
                    start = part["start"].iloc[0]
                    at = len(seqs) if pd.isna(start) else int(np.searchsorted(seqs, int(start)))
                    if at < len(seqs):
                        p0, multiple, anchor, epoch = float(part["first_p0"].iloc[0]), int(part["first_multiple"].iloc[0]), float(refs[at]), epoch + 1
                        rows.append((name, epoch, int(seqs[at]), p0, multiple, anchor))
                        at += 1
                step = frame.tick * multiple
                while len(out := np.flatnonzero(frame.leaves(refs[at:], p0, step, anchor))):
                    at += int(out[0])
                    p0, epoch, anchor = frame.around(float(refs[at]), step), epoch + 1, None if anchor is None else float(refs[at])
                    rows.append((name, epoch, int(seqs[at]), p0, multiple, anchor))
                    at += 1
            yield pd.DataFrame(rows, columns=_EPOCH)

    ordered = given.repartition("stream").sortWithinPartitions("stream", "seq")
    return ordered.mapInPandas(run, "stream string, epoch int, from_seq long, p0 double, tick_multiple int, anchor double")


def hybrid_epochs(middles: DataFrame, rows: int, core_rows: int, core_step: float, up_mult: float, dn_floor: float) -> DataFrame:
    """(stream, from_seq, scale): the first middle around which a hybrid scale can be made; it then stays."""
    made = middles.withColumn("scale", make_hybrid(F.col("ref"), rows, core_rows, core_step, up_mult, dn_floor)).where("scale IS NOT NULL")
    return made.groupBy("stream").agg(F.min("seq").alias("from_seq"), F.min_by("scale", "seq").alias("scale"))


def moving_density(levels: DataFrame, epochs: DataFrame, tick: float, rows: int, dt_ns: int, ring: int | None = None) -> DataFrame:
    """(stream, epoch, col_idx, row, bid, ask) of full books under frames that move.

    ``levels`` are (stream, seq, ts_ns, side, price, size), all levels of a book under one ``seq``; ``epochs`` as
    ``epoch_table`` gives them. A book stands until the next; a column has the epoch of the book that covers its
    end. A cell must lie on the grid in every epoch from its book's to its column's, as each move drops what falls
    off, and a move to another step drops all.
    """
    books = levels.groupBy("stream", "seq").agg(F.first("ts_ns").alias("ts_ns"))
    started = epochs.select("stream", F.col("from_seq").alias("seq"), "epoch", F.lit(0).alias("_rank"))  # before the book of the same place
    both = books.withColumn("_rank", F.lit(1)).unionByName(started, allowMissingColumns=True)
    timed = running(both, ("seq", "_rank"), {"eff": ("max", F.col("ts_ns")), "_epoch": ("max", F.col("epoch"))}).where("_rank = 1")
    placed = timed.select("stream", "seq", "eff", F.col("_epoch").alias("epoch"), (-F.col("seq")).alias("_back"))
    # The next book is the last one before in reverse order.
    spans = running(placed, ("_back",), {"till": ("last", F.col("eff"))}, before=True).drop("_back").where("till > eff")
    cut = spans.withColumn("col_idx", F.explode(F.sequence(floor_div(F.col("eff"), dt_ns), floor_div(F.col("till") - 1, dt_ns))))
    if ring is not None:
        first, last = floor_div(F.col("eff"), dt_ns), floor_div(F.col("till"), dt_ns)
        cut = cut.where((last - first <= ring + 1) | (F.col("col_idx") == first) | (F.col("col_idx") >= last - ring))
    # Only columns that a later book closes exist; each has the epoch of the span that covers its end.
    end = (F.col("col_idx") + 1) * dt_ns
    closing = cut.where((F.col("eff") < end) & (F.col("till") >= end)).select("stream", "col_idx", F.col("epoch").alias("col_epoch"))
    pieces = cut.join(closing, ["stream", "col_idx"])
    overlap = F.least(F.col("till"), end) - F.greatest(F.col("eff"), F.col("col_idx") * dt_ns)
    pieces = pieces.select("stream", "seq", "col_idx", "epoch", "col_epoch", (overlap / F.lit(float(dt_ns))).alias("share"))
    # Frames passed between a book and the end of its column: their least and largest p0.
    passed = pieces.select("stream", "epoch", "col_epoch").distinct().alias("p")
    e = epochs.select("stream", F.col("epoch").alias("e"), "p0", "tick_multiple")
    reach = passed.withColumn("e", F.explode(F.sequence("epoch", "col_epoch"))).join(e, ["stream", "e"])
    reach = reach.groupBy("stream", "epoch", "col_epoch").agg(F.min("p0").alias("low"), F.max("p0").alias("high"), F.max_by("p0", "e").alias("p0_col"), F.min_by("p0", "e").alias("p0_own"), F.min("tick_multiple").alias("multiple"), F.max("tick_multiple").alias("_most"))
    reach = reach.where("multiple = _most").withColumn("step", F.lit(tick) * F.col("multiple"))
    cells = pieces.join(reach, ["stream", "epoch", "col_epoch"]).join(levels.select("stream", "seq", "side", "price", "size"), ["stream", "seq"])
    own = F.rint((F.col("price") - F.col("p0_own")) / F.col("step"))
    moved = lambda p0: own - F.rint((F.col(p0) - F.col("p0_own")) / F.col("step"))
    inside = (own >= 0) & (own < rows) & (moved("high") >= 0) & (moved("low") < rows)
    kept = cells.where(inside & (F.abs("price") < float("inf")) & (F.abs("size") < float("inf"))).withColumn("row", moved("p0_col").cast("int"))
    side = lambda s: half_float(F.sum(F.when(F.col("side") == s, F.col("size") * F.col("share")).otherwise(0.0)))
    return kept.groupBy("stream", F.col("col_epoch").alias("epoch"), "col_idx", "row").agg(side(0).alias("bid"), side(1).alias("ask"))
