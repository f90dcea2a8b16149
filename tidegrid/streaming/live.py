"""The live grid: micro-batches of level updates and trades become finished columns and bars by set-wise jobs.

Time-weighted density adds up over time, so a batch needs little of the past: the levels that stand, the sums of
the column that is open, the frame in force, and the session's running sums. These are small tables (``StateTables``).
A batch joins them to its events, runs the operators of the batch form, and writes its results and the next state
under its own number, in place of what a former try left there. Results over all batches equal the batch form over
all events, however the events are cut into batches.

A batch is cut into parts of time at the books that move the frame and at those that jump: after a jump over more than
``ring`` + 1 columns only the column that it leaves and the last ``ring`` before the one it reaches exist. A part has
one frame, a level goes to the parts that it stands in by key, and a column has the frame that is in force at its end.
What the open column holds moves with the frame, by whole rows; rows that fall off the grid on the way are lost, and
so is all of it where the step or the kind of the scale changes.

The column that is open is given as well, with what it holds so far, until it is finished (``depth``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div
from tidegrid.functions.scale import Scale, bin_row, finite, make_hybrid
from tidegrid.operators import bars as ob
from tidegrid.operators import density as od
from tidegrid.operators.epochs import Frame, moves
from tidegrid.operators.ingest import anchor_reference
from tidegrid.operators.running import running
from tidegrid.streaming.state import BEFORE_ALL, StateTables, children, remove

#: Events of a batch: kind ``level`` sets a level (size 0 removes it; a snapshot row empties the book first), kind
#: ``trade`` is a print, kind ``anchor`` gives in ``price`` what a frame follows from the book of the same ``seq`` on.
#: Books that come whole, all their rows of one ``seq`` being snapshot rows, need no anchor: their middle is taken.
#: ``seq`` rises over all events of a stream.
EVENTS = "stream string, seq long, ts_ns long, kind string, side int, price double, size double, is_snapshot boolean"
_SCALE = ("scale_kind", "dn_rows", "core_rows", "core_p0", "core_step", "lo_price", "hi_price")
STATE = {
    "clock": "stream string, now_ns long, next_col long, next_seq long, started boolean",
    "levels": "stream string, side int, price double, size double",
    "cells": "stream string, col_idx long, row int, bid double, ask double",
    "bars": "stream string, col_idx long, o double, h double, l double, c double, vol_buy double, vol_sell double, delta double, num double, den double",
    "sums": "stream string, close double, delta double, num double, den double",
    "frames": "stream string, epoch int, p0 double, tick_multiple int, anchor double, scale_kind int, dn_rows int, core_rows int, core_p0 double, core_step double, lo_price double, hi_price double",
}
_SUMS = ("vol_buy", "vol_sell", "delta", "num", "den")


@dataclass(frozen=True)
class LiveGrid:
    """For ``writeStream.foreachBatch``. ``base`` is a folder that all executors see; one query writes it.

    A grid has a ``scale`` that stays, or a ``frame`` that follows the price.
    """

    base: str
    scale: Scale | None
    dt_ns: int
    ring: int = 32_768
    frame: Frame | None = None
    state: StateTables = field(init=False, hash=False)

    def __post_init__(self):
        if (self.scale is None) == (self.frame is None):
            raise ValueError("a grid has a scale or a frame")
        object.__setattr__(self, "state", StateTables(f"{self.base}/state", STATE))

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        state = {kind: self.state.read(spark, kind, batch) for kind in STATE}
        events = events.persist()

        def hold(df: DataFrame, name: str) -> DataFrame:
            """Written and read again, so plans stay small and lost executors lose nothing."""
            path = f"{self.base}/work/{name}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        try:
            books = hold(self._books(events, state["clock"]), "books")
            frames = hold(self._frames(events, books, state["frames"]), "frames")
            parts = hold(self._parts(books, frames, state), "parts")
            spans = hold(od.level_intervals(self._updates(events, state, parts), "part"), "spans")
            clock = hold(self._clock(events, books, state["clock"]), "clock")
            columns = hold(self._given(parts, clock), "columns")
            self._columns(spans, parts, frames, columns, clock, state, batch, hold)
            self._bars(events, columns, clock, state, batch, hold)
            if self.frame:
                self._emit(self._described(frames.where("NOT known")), "epochs", batch)
            self.state.keep(clock.withColumn("next_seq", F.col("next_seq") + F.greatest(F.lit(0), F.coalesce(F.col("open_col") - F.col("next_col"), F.lit(0)))).withColumn("next_col", F.greatest("next_col", "open_col")), "clock", batch)
            self.state.keep(spans.where("till_ns IS NULL"), "levels", batch)
            newest = Window.partitionBy("stream").orderBy(F.desc("epoch"))
            self.state.keep(frames.withColumn("_n", F.row_number().over(newest)).where("_n = 1"), "frames", batch)
            self.state.prune(spark, batch)
            for name in children(spark, f"{self.base}/open"):  # those of batches before the last two
                if name.startswith("batch=") and int(name[6:]) < batch - 1:
                    remove(spark, f"{self.base}/open/{name}")
        finally:
            events.unpersist()

    def _emit(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{kind}/batch={batch}")

    def _books(self, events: DataFrame, clock: DataFrame) -> DataFrame:
        """(stream, seq, before, eff): the time reached before each book, null for the first of all, and by it."""
        own = events.where("kind = 'level'").groupBy("stream", "seq").agg(F.max("ts_ns").alias("ts_ns"))
        reached = clock.where("now_ns IS NOT NULL").select("stream", F.lit(BEFORE_ALL).alias("seq"), F.col("now_ns").alias("ts_ns"))
        timed = running(own.unionByName(reached), ("seq",), {"before": ("max", F.col("ts_ns"))}, before=True)
        books = timed.where(F.col("seq") > BEFORE_ALL).select("stream", "seq", "before", F.greatest("before", "ts_ns").alias("eff"))
        anchored = clock.select("stream", (F.col("next_col") * self.dt_ns).alias("_left")).unionByName(self._first_prints(events, clock).select("stream", (F.col("_print") * self.dt_ns).alias("_left")))
        return books.join(anchored, "stream", "left").withColumn("before", F.coalesce("before", "_left")).drop("_left")

    def _first_prints(self, events: DataFrame, clock: DataFrame) -> DataFrame:
        """(stream, _print): the column of the first print of a stream that began with one, before any book."""
        first = events.where("kind IN ('level', 'trade')").groupBy("stream").agg(F.min_by(F.struct("kind", "ts_ns"), F.struct("seq", "kind")).alias("x")).where("x.kind = 'trade'")
        return first.join(clock.where("next_col IS NOT NULL").select("stream"), "stream", "left_anti").select("stream", floor_div(F.col("x.ts_ns"), self.dt_ns).alias("_print"))

    def _frames(self, events: DataFrame, books: DataFrame, former: DataFrame) -> DataFrame:
        """(stream, epoch, at_ns, at_seq, known, ...): the frame in force before the batch and those that its books bring."""
        spark = events.sparkSession
        if self.frame is None:
            return spark.createDataFrame([], f"{STATE['frames']}, at_seq long, at_ns long, known boolean")
        f = self.frame
        none = {c: F.lit(None).cast("int" if c.endswith("rows") else "double") for c in _SCALE[1:]}
        new = events.select("stream").distinct().join(former, "stream", "left_anti").select("stream", F.lit(0).alias("epoch"), F.lit(float(f.p0)).alias("p0"), F.lit(f.tick_multiple).alias("tick_multiple"), F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("scale_kind"), *(v.alias(c) for c, v in none.items()))
        start = former.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False))).withColumn("at_seq", F.lit(BEFORE_ALL)).withColumn("at_ns", F.lit(None).cast("long"))
        given = events.where("kind = 'anchor'").select("stream", "seq", F.col("price").alias("ref"))
        rows = events.where("kind = 'level'").join(given.select("stream", "seq"), ["stream", "seq"], "left_anti")
        whole = rows.groupBy("stream", "seq").agg(F.min("is_snapshot").alias("whole")).where("whole")
        middles = given.unionByName(anchor_reference(rows.join(whole.select("stream", "seq"), ["stream", "seq"])))
        if f.band is not None and f.core_rows is not None:
            up, down = f.band
            made = middles.join(start.where("anchor IS NULL").select("stream", "epoch"), "stream").withColumn("made", make_hybrid(F.col("ref"), f.rows, f.core_rows, f.tick * f.tick_multiple, 1.0 + up, max(1e-6, 1.0 - down))).where("made IS NOT NULL")
            first = made.groupBy("stream").agg(F.max("epoch").alias("epoch"), F.min("seq").alias("at_seq"), F.min_by(F.struct("ref", "made"), "seq").alias("x"))
            moved = first.select("stream", (F.col("epoch") + 1).alias("epoch"), F.col("x.made.core_p0").alias("p0"), F.lit(f.tick_multiple).alias("tick_multiple"), F.col("x.ref").alias("anchor"), F.lit(1).alias("scale_kind"), *(F.col(f"x.made.{c}").alias(c) for c in _SCALE[1:]), "at_seq")
        else:
            moved = moves(middles, f, start).withColumnRenamed("from_seq", "at_seq").withColumns({"scale_kind": F.lit(0), **none})
        at = moved.join(books.select("stream", F.col("seq").alias("at_seq"), F.col("eff").alias("at_ns")), ["stream", "at_seq"])
        return start.unionByName(at.withColumn("known", F.lit(False)))

    def _parts(self, books: DataFrame, frames: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
        """(stream, part, epoch, from_ns, till_ns, at_seq): parts of time, each with one frame; they are numbered from 0 by stream.

        There is one for each move of the frame and each jump, so few.
        """
        k = lambda c: floor_div(F.col(c), self.dt_ns)
        jumps = books.where(k("eff") - k("before") > self.ring + 1).select("stream", "seq", F.lit(0).alias("kind"), ((k("before") + 1) * self.dt_ns).alias("ends"), ((k("eff") - self.ring) * self.dt_ns).alias("begins"), F.lit(None).cast("int").alias("epoch"))
        moved = frames.where(F.col("at_seq") > BEFORE_ALL).select("stream", F.col("at_seq").alias("seq"), F.lit(1).alias("kind"), F.col("at_ns").alias("ends"), F.col("at_ns").alias("begins"), "epoch")
        streams = books.select("stream").union(state["clock"].select("stream")).distinct()
        first = streams.join(frames.where(F.col("at_seq") == BEFORE_ALL).select("stream", "epoch"), "stream", "left").select("stream", F.lit(BEFORE_ALL).alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ends"), F.lit(None).cast("long").alias("begins"), F.coalesce("epoch", F.lit(0)).alias("epoch"))
        order = Window.partitionBy("stream").orderBy("seq", "kind", "epoch")
        cut = first.unionByName(jumps).unionByName(moved)
        return cut.select("stream", (F.row_number().over(order) - 1).cast("long").alias("part"), F.last("epoch", ignorenulls=True).over(order).alias("epoch"), F.col("begins").alias("from_ns"), F.lead("ends").over(order).alias("till_ns"), F.col("seq").alias("at_seq"))

    def _updates(self, events: DataFrame, state: dict[str, DataFrame], parts: DataFrame) -> DataFrame:
        """The batch's level updates after the standing book, which comes as a snapshot at the time reached so far, if there was one; and where parts begin."""
        fields = ("stream", "seq", "ts_ns", "side", "price", "amount", "is_snapshot", "part")
        own = events.where("kind = 'level'").withColumnRenamed("size", "amount").withColumn("part", F.lit(None).cast("long")).select(*fields)
        nothing = (F.lit(None).cast("int").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("amount"))
        reached = state["clock"].where("now_ns IS NOT NULL").select("stream", F.col("now_ns").alias("ts_ns"), F.col("started").alias("is_snapshot"))
        mark = reached.select("stream", "ts_ns", "is_snapshot", *nothing)
        standing = mark.union(state["levels"].join(reached, "stream").select("stream", "ts_ns", "is_snapshot", "side", "price", "size"))
        begun = parts.select("stream", F.col("at_seq").alias("seq"), F.lit(None).cast("long").alias("ts_ns"), *nothing, F.lit(False).alias("is_snapshot"), "part")
        return own.unionByName(standing.withColumn("seq", F.lit(BEFORE_ALL)).withColumn("part", F.lit(0).cast("long")).select(*fields)).unionByName(begun)

    def _clock(self, events: DataFrame, books: DataFrame, former: DataFrame) -> DataFrame:
        """(stream, now_ns, next_col, next_seq, open_col, started): time reached, the first column not given yet and its number, the one that is open, whether a snapshot came."""
        snapshots = events.where("kind = 'level'").groupBy("stream").agg(F.max("is_snapshot").alias("_snap"))
        now = books.groupBy("stream").agg(F.max("eff").alias("_now"), F.min_by("eff", "seq").alias("_first"))
        prints = self._first_prints(events, former)
        both = former.join(now, "stream", "full").join(prints, "stream", "full").join(snapshots, "stream", "left")
        open_col = floor_div(F.greatest("_now", "now_ns"), self.dt_ns)
        first = F.least(floor_div(F.col("_first"), self.dt_ns), F.col("_print"))
        started = F.coalesce(F.col("started"), F.lit(False)) | F.coalesce(F.col("_snap"), F.lit(False))
        return both.select("stream", F.greatest("_now", "now_ns").alias("now_ns"), F.coalesce("next_col", first).alias("next_col"), F.coalesce("next_seq", F.lit(0)).alias("next_seq"), open_col.alias("open_col"), started.alias("started"))

    def _given(self, parts: DataFrame, clock: DataFrame) -> DataFrame:
        """(stream, col_idx, col_seq, epoch, final) of the columns that this batch finishes, and of the open one."""
        of = parts.join(clock.where("open_col IS NOT NULL"), "stream")
        low = F.greatest(F.col("next_col"), floor_div(F.col("from_ns"), self.dt_ns))
        high = F.least(F.col("open_col"), floor_div(F.col("till_ns") - 1, self.dt_ns))
        # A frame that begins and ends within a column still passes it.
        high = F.greatest(high, floor_div(F.col("from_ns"), self.dt_ns))
        each = of.where(low <= high).withColumn("col_idx", F.explode(F.sequence(low, high)))
        out = each.groupBy("stream", "col_idx").agg(F.max("epoch").alias("epoch"), F.max("open_col").alias("open_col"), F.max("next_col").alias("next_col"), F.max("next_seq").alias("next_seq"))
        return out.select("stream", "col_idx", (F.col("next_seq") + F.col("col_idx") - F.col("next_col")).alias("col_seq"), "epoch", (F.col("col_idx") < F.col("open_col")).alias("final"))

    def _columns(self, spans: DataFrame, parts: DataFrame, frames: DataFrame, columns: DataFrame, clock: DataFrame, state: dict[str, DataFrame], batch: int, hold) -> None:
        ended = spans.join(clock.select("stream", "now_ns"), "stream")
        last = parts.groupBy("stream").agg(F.max("part").alias("_last"))
        through = ended.join(last, "stream").withColumn("part", F.explode(F.sequence(F.col("carried_from"), F.coalesce("carried_till", "_last"))))
        pieces = through.join(parts.select("stream", "part", "epoch", F.col("from_ns").alias("_from"), F.col("till_ns").alias("_till")), ["stream", "part"])
        pieces = pieces.withColumn("from_ns", F.greatest("from_ns", "_from")).withColumn("till_ns", F.least(F.coalesce("till_ns", "now_ns"), "_till")).where("till_ns > from_ns")
        before = state["cells"].join(parts.where("part = 0").select("stream", "epoch"), "stream")
        if self.frame is None:
            own = od.density(pieces, self.scale, self.dt_ns).withColumn("epoch", F.lit(0)).unionByName(before)
        else:
            own = self._density(pieces, frames).unionByName(before)
        cells = own.join(columns.withColumnRenamed("epoch", "col_epoch"), ["stream", "col_idx"])
        if self.frame is not None:
            cells = self._shifted(cells, frames)
        cells = cells.groupBy("stream", "col_idx", "row").agg(F.sum("bid").alias("bid"), F.sum("ask").alias("ask"), F.max("col_epoch").alias("epoch"), F.max("col_seq").alias("col_seq"), F.max("final").alias("final"))
        cells = hold(cells, "cells")
        own = ("stream", "epoch", "col_seq", "col_idx", (F.col("col_idx") * self.dt_ns).alias("t0_ns"), "row", "bid", "ask")
        self._emit(cells.where("final").select(*own), "cells", batch)
        self._emit(cells.where("NOT final").select(*own), "open", batch)
        self.state.keep(cells.where("NOT final").select("stream", "col_idx", "row", "bid", "ask"), "cells", batch)

    def _scale_of(self, frames: DataFrame) -> DataFrame:
        return frames.withColumn("rows", F.lit(self.frame.rows)).withColumn("tick", F.lit(float(self.frame.tick)))

    def _density(self, pieces: DataFrame, frames: DataFrame) -> DataFrame:
        """(stream, epoch, col_idx, row, bid, ask) of pieces of levels, each under the frame of its own time."""
        framed = pieces.select("stream", "epoch", "side", "price", "size", "from_ns", "till_ns").join(self._scale_of(frames), ["stream", "epoch"])
        placed = framed.withColumn("row", bin_row(Scale.of(), F.col("price"))).where(F.col("row").isNotNull() & finite(F.col("size")))
        first, last = (floor_div(c, self.dt_ns) for c in (F.col("from_ns"), F.col("till_ns") - 1))
        cut = placed.select("stream", "epoch", "side", "size", "row", "from_ns", "till_ns", F.explode(F.sequence(first, last)).alias("col_idx"))
        start = F.col("col_idx") * self.dt_ns
        share = F.col("size") * (F.least(F.col("till_ns"), start + self.dt_ns) - F.greatest(F.col("from_ns"), start)) / F.lit(float(self.dt_ns))
        side = lambda s: F.sum(F.when(F.col("side") == s, share).otherwise(0.0))
        return cut.groupBy("stream", "epoch", "col_idx", "row").agg(side(0).alias("bid"), side(1).alias("ask"))

    def _shifted(self, cells: DataFrame, frames: DataFrame) -> DataFrame:
        """Cells in rows of their column's frame; what left the grid under any frame between is gone."""
        f = self.frame
        passed = cells.where("epoch < col_epoch").select("stream", "epoch", "col_epoch").distinct()
        own = frames.select("stream", F.col("epoch").alias("e"), "p0", "tick_multiple", "scale_kind")
        reach = passed.withColumn("e", F.explode(F.sequence("epoch", "col_epoch"))).join(own, ["stream", "e"])
        same = (F.min("tick_multiple") == F.max("tick_multiple")) & (F.max("scale_kind") == 0)
        reach = reach.groupBy("stream", "epoch", "col_epoch").agg(F.min("p0").alias("low"), F.max("p0").alias("high"), F.min_by("p0", "e").alias("from_p0"), F.max_by("p0", "e").alias("to_p0"), (f.tick * F.max("tick_multiple")).alias("step"), same.alias("same"))
        joined = cells.join(reach, ["stream", "epoch", "col_epoch"], "left")
        by = lambda p0: F.rint((F.col(p0) - F.col("from_p0")) / F.col("step")).cast("int")
        stays = F.coalesce(F.col("same") & (F.col("row") - by("high") >= 0) & (F.col("row") - by("low") < f.rows), F.lit(True) & F.col("same").isNull())
        return joined.where(stays).withColumn("row", F.when(F.col("same").isNull(), F.col("row")).otherwise(F.col("row") - by("to_p0")))

    def _bars(self, events: DataFrame, columns: DataFrame, clock: DataFrame, state: dict[str, DataFrame], batch: int, hold) -> None:
        reached = state["clock"].where("now_ns IS NOT NULL").select("stream", F.lit(BEFORE_ALL).alias("seq"), F.col("now_ns").alias("ts_ns"))
        books = events.where("kind = 'level'").select("stream", "seq", "ts_ns").unionByName(reached)
        trades = ob.trade_columns(events.where("kind = 'trade'").select("stream", "seq", "ts_ns", "side", "price", "size"), books, self.dt_ns)
        trades = trades.join(clock.select("stream", "next_col"), "stream").withColumn("col_idx", F.greatest("next_col", "col_idx")).drop("next_col")  # late prints before any book
        parts = ob.trade_bars(trades, self.dt_ns, "col_idx").withColumn("part", F.lit(1)).unionByName(state["bars"].withColumn("part", F.lit(0)))
        merged = parts.groupBy("stream", "col_idx").agg(
            F.min_by("o", "part").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "part").alias("c"), *(F.sum(c).alias(c) for c in _SUMS)
        )
        merged = hold(merged, "merged")
        given = columns.join(merged, ["stream", "col_idx"], "left").join(state["sums"].select("stream", F.col("close").alias("_close"), *(F.col(c).alias(f"_{c}") for c in ("delta", "num", "den"))), "stream", "left")
        so_far = Window.partitionBy("stream").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)  # the columns of one batch
        close = F.coalesce(F.last("c", ignorenulls=True).over(so_far), F.col("_close"))
        total = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(so_far) + F.coalesce(f"_{c}", F.lit(0.0))
        done = given.select(
            "stream", "epoch", "col_seq", "col_idx", (F.col("col_idx") * self.dt_ns).alias("t0_ns"), *(F.coalesce(x, close).alias(x) for x in "ohl"), close.alias("c"), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("vol_buy", "vol_sell")),
            total("delta").alias("cvd_cum"), total("num").alias("vwap_num_cum"), total("den").alias("vwap_den_cum"), "final",
        )
        done = hold(done, "done")
        self._emit(done.where("final").drop("final"), "bars", batch)
        self._emit(done.where("NOT final").drop("final"), "open_bars", batch)
        last = done.where("final").groupBy("stream").agg(F.max_by("c", "col_idx").alias("close"), F.max_by("cvd_cum", "col_idx").alias("delta"), F.max_by("vwap_num_cum", "col_idx").alias("num"), F.max_by("vwap_den_cum", "col_idx").alias("den"))
        self.state.keep(last.unionByName(state["sums"].join(last, "stream", "left_anti")), "sums", batch)
        self.state.keep(merged.join(clock.select("stream", "open_col"), "stream", "left").where(~self._finished()), "bars", batch)

    def _finished(self) -> Column:
        return F.coalesce(F.col("col_idx") < F.col("open_col"), F.lit(False))

    def _described(self, frames: DataFrame) -> DataFrame:
        """Epochs with all fields of their scale, and the place from which they hold."""
        return self._scale_of(frames).select("stream", "epoch", "tick", "tick_multiple", F.lit(self.dt_ns).cast("long").alias("dt_ns"), "p0", "rows", *_SCALE, F.when(F.col("at_seq") > BEFORE_ALL, F.col("at_seq")).alias("from_seq"), "at_ns")

    def cells(self, spark: SparkSession) -> DataFrame:
        """Finished cells so far (stream, epoch, col_seq, col_idx, t0_ns, row, bid, ask)."""
        return spark.read.parquet(f"{self.base}/cells").drop("batch")

    def bars(self, spark: SparkSession) -> DataFrame:
        """Bars of finished columns so far, with the session's running sums."""
        return spark.read.parquet(f"{self.base}/bars").drop("batch")

    def epochs(self, spark: SparkSession) -> DataFrame:
        """Frames so far, each announced by the batch that brought it."""
        return spark.read.parquet(f"{self.base}/epochs").drop("batch")

    def open_column(self, spark: SparkSession, batch: int) -> DataFrame:
        """The column that was open after a batch, as it stood then; of the last two batches."""
        return self.state.read(spark, "cells", batch + 1)

    def depth(self, spark: SparkSession) -> DataFrame:
        """Finished cells, and those of the open column so far with ``final`` false; a column is given as one or the other."""
        return self._with_open(spark, self.cells(spark), "open")

    def all_bars(self, spark: SparkSession) -> DataFrame:
        """Bars with those of the open columns so far, ``final`` false."""
        return self._with_open(spark, self.bars(spark), "open_bars")

    def _with_open(self, spark: SparkSession, finished: DataFrame, kind: str) -> DataFrame:
        done = [int(n[6:]) for n in children(spark, f"{self.base}/{kind}") if n.startswith("batch=") and "_SUCCESS" in children(spark, f"{self.base}/{kind}/{n}")]
        partial = spark.read.schema(finished.schema).parquet(f"{self.base}/{kind}/batch={max(done)}")
        partial = partial.join(self.bars(spark).select("stream", "epoch", "col_seq"), ["stream", "epoch", "col_seq"], "left_anti")
        return finished.withColumn("final", F.lit(True)).unionByName(partial.withColumn("final", F.lit(False)))

    def start_from(self, tail: dict[str, DataFrame]) -> DataFrame:
        """Let batch 0 go on where a recorded tail (``store.tail``) ends; (stream, ts_ns, kind, text) marks the gap of each stream that does.

        Counters, frame, close and running sums are restored, time starts anew with the first event. A stream's
        tail is refused, and the stream starts cold, where its columns are not consecutive in number and rising in
        time, or an epoch is missing or of another shape than this grid.
        """
        spark = tail["bars"].sparkSession
        bars = tail["bars"].select("stream", "epoch", "col_seq", "t0_ns", "c", "cvd_cum", "vwap_num_cum", "vwap_den_cum").persist()
        by_seq = Window.partitionBy("stream").orderBy("col_seq")  # of at most the columns of a tail
        steps = bars.select("stream", F.col("col_seq") - F.lag("col_seq").over(by_seq), F.col("t0_ns") - F.lag("t0_ns").over(by_seq)).toDF("stream", "seqs", "time")
        broken = steps.where("seqs <> 1 OR time <= 0").select("stream").distinct()
        epochs = tail["epochs"]
        shape = F.col("dt_ns") == self.dt_ns
        if self.frame is not None:
            shape &= (F.col("rows") == self.frame.rows) & (F.col("tick") == self.frame.tick)
            shape &= F.lit(self.frame.band is not None) | (F.col("tick_multiple") == self.frame.tick_multiple)
        fit = bars.select("stream", "epoch").distinct().join(epochs.where(shape).select("stream", "epoch", "tick_multiple"), ["stream", "epoch"], "left")
        unfit = fit.groupBy("stream").agg(F.max(F.col("tick_multiple").isNull()).alias("missing"), F.count_distinct("tick_multiple").alias("steps")).where("missing OR steps > 1").select("stream")
        sound = bars.join(broken, "stream", "left_anti").join(unfit, "stream", "left_anti")
        last = sound.groupBy("stream").agg(F.max_by(F.struct(*sound.columns), "col_seq").alias("x")).select("x.*").persist()
        empty = {kind: spark.createDataFrame([], STATE[kind]) for kind in STATE}
        state = dict(empty)
        state["clock"] = last.select("stream", F.lit(None).cast("long").alias("now_ns"), F.lit(None).cast("long").alias("next_col"), (F.col("col_seq") + 1).alias("next_seq"), F.lit(False).alias("started"))
        state["sums"] = last.select("stream", F.col("c").alias("close"), F.col("cvd_cum").alias("delta"), F.col("vwap_num_cum").alias("num"), F.col("vwap_den_cum").alias("den"))
        if self.frame is not None:
            centre = F.col("p0") + self.frame.rows * self.frame.tick * F.col("tick_multiple") / 2
            anchored = F.when(F.lit(self.frame.band is not None) & ((F.col("epoch") > 0) | (F.col("scale_kind") == 1)), centre)
            state["frames"] = last.select("stream", "epoch").join(epochs, ["stream", "epoch"]).withColumn("anchor", anchored).withColumn("scale_kind", F.coalesce("scale_kind", F.lit(0)))
        for kind, rows in state.items():
            self.state.keep(rows, kind, -1)
        ends = F.col("t0_ns") + self.dt_ns
        out = last.select("stream", (ends - 1).alias("ts_ns"), F.lit("gap").alias("kind"), F.concat(F.lit("restart: recording ends "), ends.cast("string")).alias("text")).collect()  # a row a stream of one instrument
        last.unpersist()
        bars.unpersist()
        return spark.createDataFrame(out, "stream string, ts_ns long, kind string, text string")
