"""Maps between price and row: linear, and hybrid with a linear core between two logarithmic wings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND_MARGIN = 1.25


def nan() -> Column:
    return F.lit(float("nan"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@dataclass(frozen=True)
class Scale:
    """Columns or numbers of one scale; ``kind`` 1 is hybrid, any other is linear."""

    kind: Column
    rows: Column
    p0: Column
    step: Column
    dn_rows: Column
    core_rows: Column
    core_p0: Column
    core_step: Column
    lo_price: Column
    hi_price: Column

    @staticmethod
    def of(prefix: str = "") -> Scale:
        """From the columns of an epoch; what is missing there makes it linear."""
        c = lambda name: F.col(prefix + name)
        return Scale(
            F.coalesce(c("scale_kind"), F.lit(0)), c("rows"), c("p0"), c("tick") * c("tick_multiple"), c("dn_rows"), c("core_rows"),
            c("core_p0"), c("core_step"), c("lo_price"), c("hi_price"),
        )

    @staticmethod
    def linear(p0: float, step: float, rows: int) -> Scale:
        none = F.lit(None).cast("double")
        return Scale(F.lit(0), F.lit(rows), F.lit(float(p0)), F.lit(float(step)), *(none,) * 6)

    @staticmethod
    def hybrid(rows: int, dn_rows: int, core_rows: int, core_p0: float, core_step: float, lo_price: float, hi_price: float) -> Scale:
        numbers = (float(x) for x in (core_p0, core_step, lo_price, hi_price))
        return Scale(F.lit(1), F.lit(rows), F.lit(float(core_p0)), F.lit(float(core_step)), F.lit(dn_rows), F.lit(core_rows), *map(F.lit, numbers))

    @property
    def core_hi(self) -> Column:
        return self.core_p0 + self.core_rows * self.core_step

    @property
    def up_rows(self) -> Column:
        return F.greatest(F.lit(0), self.rows - self.dn_rows - self.core_rows)

    def hybrid_usable(self) -> Column:
        up = (self.up_rows == 0) | (finite(self.hi_price) & (self.hi_price > self.core_hi))
        return F.coalesce(
            (self.kind == 1) & (self.rows > 0) & finite(self.lo_price) & (self.lo_price > 0) & finite(self.core_p0) & finite(self.core_step)
            & (self.core_step > 0) & (self.core_rows >= 1) & (self.dn_rows >= 0) & (self.rows >= self.dn_rows + self.core_rows)
            & (self.core_p0 > self.lo_price) & up,
            F.lit(False),
        )

    def linear_usable(self) -> Column:
        return F.coalesce(finite(self.step) & (self.step > 0) & (self.rows > 0), F.lit(False))

    def price_to_row(self, price: Column) -> Column:
        core_end = self.dn_rows + self.core_rows
        below = F.when(self.dn_rows <= 0, self.dn_rows + self.core_p0 / self.core_step * F.log(price / self.core_p0)).otherwise(
            self.dn_rows * (1.0 + F.log(price / self.core_p0) / F.log(self.core_p0 / self.lo_price))
        )
        above = F.when(self.up_rows <= 0, core_end + self.core_hi / self.core_step * F.log(price / self.core_hi)).otherwise(
            core_end + self.up_rows * (F.log(price / self.core_hi) / F.log(self.hi_price / self.core_hi))
        )
        hybrid = F.when(~(price > 0) | F.isnan(price), nan()).when(price < self.core_p0, below).when(price <= self.core_hi, self.dn_rows + (price - self.core_p0) / self.core_step).otherwise(above)
        linear = F.when(self.step == 0, nan()).otherwise((price - self.p0) / self.step)
        return F.when(self.hybrid_usable(), hybrid).otherwise(linear)

    def row_to_price(self, row: Column) -> Column:
        core_end = self.dn_rows + self.core_rows
        from_core = row - self.dn_rows
        below = F.when(self.dn_rows <= 0, self.core_p0 * F.exp(from_core * (self.core_step / self.core_p0))).otherwise(
            self.core_p0 * F.exp(from_core / self.dn_rows * F.log(self.core_p0 / self.lo_price))
        )
        above = F.when(self.up_rows <= 0, self.core_hi * F.exp((row - core_end) * (self.core_step / self.core_hi))).otherwise(
            self.core_hi * F.exp((row - core_end) / self.up_rows * F.log(self.hi_price / self.core_hi))
        )
        hybrid = F.when(row < self.dn_rows, below).when(row <= core_end, self.core_p0 + from_core * self.core_step).otherwise(above)
        return F.when(self.hybrid_usable(), hybrid).otherwise(self.p0 + row * self.step)

    def step_at_row(self, row: Column) -> Column:
        """Price width of a row."""
        return F.when(self.hybrid_usable(), self.row_to_price(row + 0.5) - self.row_to_price(row - 0.5)).otherwise(self.step)


def bin_row(scale: Scale, price: Column) -> Column:
    """Row of a price, half to even; null off the grid or for what is no number."""
    exact = scale.price_to_row(price)
    row = F.rint(exact)
    return F.when(finite(exact) & (row >= 0) & (row < scale.rows), row.cast("int"))


def make_hybrid(mid: Column, rows: int, core_rows: int, core_step: float, up_mult: float, dn_floor: float) -> Column:
    """Struct of a hybrid scale around ``mid``; null where none can be made.

    Rows beyond the core go to the wings by their logarithmic spans, one at least to each.
    """
    nothing = F.lit(None).cast("struct<rows:int,dn_rows:int,core_rows:int,core_p0:double,core_step:double,lo_price:double,hi_price:double>")
    if not (core_step > 0 and rows > core_rows >= 1 and up_mult > 1 and 0 < dn_floor < 1):
        return nothing
    half = core_rows * core_step / 2
    core_p0, lo, hi = mid - half, mid * dn_floor, mid * up_mult
    core_hi = core_p0 + core_rows * core_step
    log_dn, log_up = F.log(core_p0 / lo), F.log(hi / core_hi)
    wing = rows - core_rows
    dn = F.least(F.lit(wing - 1), F.greatest(F.lit(1), F.rint(wing * log_dn / (log_dn + log_up)).cast("int")))
    made = F.struct(
        F.lit(rows).alias("rows"), dn.alias("dn_rows"), F.lit(core_rows).alias("core_rows"), core_p0.alias("core_p0"),
        F.lit(float(core_step)).alias("core_step"), lo.alias("lo_price"), hi.alias("hi_price"),
    )
    good = finite(mid) & (mid > 0) & (lo > 0) & (lo < core_p0) & (hi > core_hi) & (log_dn > 0) & (log_up > 0) & (F.lit(rows) >= dn + core_rows)
    return F.when(good, made)


def band_frame(mid: Column, up: float, down: float, tick: float, rows: int) -> Column:
    """Struct (p0, tick_multiple) of a linear frame that covers mid·(1-down) … mid·(1+up); null where none can be made.

    The least multiple whose rows reach the top, after p0 is rounded to the grid. Rounding moves p0 by half a
    step at most, so it lies between the multiples that reach the top with half a row more and half a row less.
    """
    lo, hi = mid * max(0.0, 1.0 - down), mid * (1.0 + up)
    span = (hi - lo) * BAND_MARGIN
    first = F.greatest(F.lit(1), F.ceil(span / (rows * tick))).cast("long")

    def frame(multiple: Column) -> Column:
        step = tick * multiple
        return F.struct((F.rint((mid - span / 2) / step) * step).alias("p0"), multiple.cast("int").alias("tick_multiple"))

    reach = hi - mid + span / 2
    least, most = (F.ceil(reach / ((rows + more) * tick)).cast("long") for more in (0.5, -0.5))
    start = F.greatest(first, least - 1)
    tried = F.transform(F.sequence(start, F.greatest(start, most + 1)), frame)
    covering = F.filter(tried, lambda f: f["p0"] + rows * tick * f["tick_multiple"] >= hi)
    good = finite(mid) & (mid > 0) & finite(span) & (span > 0) & F.lit(rows > 0 and tick > 0)
    return F.when(good, F.element_at(covering, 1))


def half_float(x: Column) -> Column:
    """The nearest half-precision value as a double: ties to even, over 65,504 infinite."""
    size = F.abs(x)
    quantum = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    rounded = F.rint(size / quantum) * quantum
    over = F.when(rounded > 65504, F.lit(float("inf"))).otherwise(rounded)
    return F.when(x.isNull() | F.isnan(x), x.cast("double")).when(size == 0, F.lit(0.0)).when(size == float("inf"), x.cast("double")).otherwise(F.signum(x) * over)


def remap_row(row: Column, source: Scale, target: Scale) -> Column:
    """The row of another epoch at the same price."""
    return target.price_to_row(source.row_to_price(row))


def remap_span(span: Column, source: Scale, target: Scale, around: Column) -> Column:
    """Width in rows of another epoch, measured around a row of the first."""
    both_linear = ~source.hybrid_usable() & ~target.hybrid_usable()
    linear = F.when(target.step == 0, nan()).otherwise(span * source.step / target.step)
    ends = [target.price_to_row(source.row_to_price(around + sign * span / 2)) for sign in (1.0, -1.0)]
    return F.when(both_linear, linear).otherwise(ends[0] - ends[1])
