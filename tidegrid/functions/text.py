"""Labels and small conversions of times, sizes and settings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.ints import floor_div

NS = 1_000_000_000
#: Speeds of replay, and steps of time axes in nanoseconds.
SPEEDS = (1, 2, 5, 10, 50, 100)
TIME_STEPS_NS = tuple(int(s * NS) for s in (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 1800, 3600))
BANDS = ("native", "wide", "full", "deep")


def hour_key(ts_ns: Column) -> Column:
    """UTC hour as yyyyMMdd-HH, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(floor_div(ts_ns, NS)).cast("timestamp_ntz")), "yyyyMMdd-HH")


def safe_name(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r"[/\\:]", "_")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", "_").otherwise(cleaned)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def clock(ns: Column) -> Column:
    """HH:MM:SS of the day."""
    s = floor_div(ns, NS)
    return F.concat_ws(":", _two(F.pmod(F.floor(s / 3600), F.lit(24))), _two(F.pmod(F.floor(s / 60), F.lit(60))), _two(F.pmod(s, F.lit(60))))


def duration(ns: Column) -> Column:
    """HH:MM:SS.mmm, hours without bound; below zero counts as zero."""
    ms = floor_div(F.greatest(ns, F.lit(0)), 1_000_000)
    hours = F.floor(ms / 3_600_000).cast("long")
    return F.concat(F.when(hours < 10, _two(hours)).otherwise(hours.cast("string")), F.lit(":"), _two(F.floor(ms / 60_000) % 60), F.lit(":"), _two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def countdown(ms: Column) -> Column:
    """HH:MM:SS with days before it if there are any."""
    s = F.floor(ms / 1000).cast("long")
    days = F.floor(s / 86400).cast("long")
    hms = F.concat_ws(":", _two(F.floor(s % 86400 / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60))
    return F.when(ms.isNull() | (ms <= 0), "00:00:00").when(days > 0, F.concat(days.cast("string"), F.lit("d "), hms)).otherwise(hms)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def size_label(v: Column) -> Column:
    """Size with B, M or K and one digit, a trailing .0 dropped; over 100 one digit, else two; empty at 0."""
    short = lambda div, suffix: F.concat(F.regexp_replace(_fixed(v / div, 1), r"\.0$", ""), F.lit(suffix))
    finite = F.when(v <= 0, "").when(v >= 1e9, short(1e9, "B")).when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "K")).when(v >= 100, _fixed(v, 1)).otherwise(_fixed(v, 2))
    return F.when(F.isnan(v), "").when(v == float("inf"), "∞").otherwise(finite)


def percent_label(v: Column) -> Column:
    sign = F.when(v > 0, "+").when(v < 0, "−").otherwise("")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "—").otherwise(F.concat(sign, _fixed(F.abs(v), 2), F.lit("%")))


def cvd_label(v: Column) -> Column:
    a = F.abs(v)
    body = F.when(a >= 1e9, F.concat(_fixed(a / 1e9, 2), F.lit("B"))).when(a >= 1e6, F.concat(_fixed(a / 1e6, 2), F.lit("M"))).when(a >= 1e3, F.concat(_fixed(a / 1e3, 1), F.lit("k"))).when(a >= 1, _fixed(a, 0)).otherwise(_fixed(a, 2))
    return F.when(v.isNull() | F.isnan(v) | (a == float("inf")), "—").when(v == 0, "0").otherwise(F.concat(F.when(v > 0, "+").otherwise("−"), body))


def snapped_speed(x: Column) -> Column:
    """The largest speed up to ``x``, or the smallest of all."""
    out = F.lit(SPEEDS[0])
    for s in SPEEDS[1:]:
        out = F.when(x >= s, s).otherwise(out)
    return out


def next_speed(x: Column, by: int = 1) -> Column:
    """The speed after ``x`` (before it, with ``by`` -1), round and round."""
    place = F.array_position(F.array(*map(F.lit, SPEEDS)), snapped_speed(x)) - 1
    return F.element_at(F.array(*map(F.lit, SPEEDS)), (F.pmod(place + by, F.lit(len(SPEEDS))) + 1).cast("int"))


def price_decimals(step: Column) -> Column:
    """Digits that tell prices one step apart: 0 to 8, and 2 for a step that is none."""
    return F.when(step > 0, F.least(F.lit(8), F.greatest(F.lit(0), F.ceil(-F.log10(step))))).otherwise(2).cast("int")


def seek_target(fraction: Column, start_ns: Column, end_ns: Column) -> Column:
    """Time at a fraction of a span, in steps of a millionth of it."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    parts = F.floor(f * 1_000_000 + 0.5).cast("decimal(20,0)")
    span = (end_ns - start_ns).cast("decimal(20,0)")
    return F.when(end_ns <= start_ns, start_ns).otherwise(start_ns + F.floor(span * parts / F.lit(1_000_000).cast("decimal(10,0)")).cast("long"))


def fraction_of(ns: Column, start_ns: Column, end_ns: Column) -> Column:
    inside = (ns - start_ns).cast("double") / (end_ns - start_ns)
    return F.when((end_ns <= start_ns) | (ns <= start_ns), 0.0).when(ns >= end_ns, 1.0).otherwise(inside)


def ts_to_col(ts_ns: Column, anchor_ns: Column, anchor_seq: Column, dt_ns: Column) -> Column:
    return anchor_seq + (ts_ns - anchor_ns) / dt_ns


def col_to_ts(col: Column, anchor_ns: Column, anchor_seq: Column, dt_ns: Column) -> Column:
    return anchor_ns + F.floor((col - anchor_seq) * dt_ns + 0.5).cast("long")


def bubble_radius(size: Column, ref: float = 4.0, base: float = 4.5, least: float = 2.5, most: float = 20.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), base * F.sqrt(F.greatest(F.lit(0.0), size) / ref)))


def nice_step(rough: Column) -> Column:
    """The next of 1, 2, 5 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    f = rough / power
    nice = F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0)
    return F.when(rough.isNull() | F.isnan(rough) | ~(rough > 0) | (rough == float("inf")), 1.0).otherwise(nice * power)


def price_ticks(lo: Column, hi: Column, target: int, least_step: Column, most: int = 1000) -> Column:
    """Array of nice prices from lo to hi, about ``target`` of them, never finer than the grid."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    step = F.greatest(nice_step((b - a) / max(1, target)), least_step)
    first = F.ceil(a / step)
    count = F.least(F.lit(most), F.floor((b + step * 1e-9) / step) - first + 1).cast("int")
    ticks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.round(first * step + i * step, 10))
    return F.when((b > a) & (count > 0), ticks).otherwise(F.array().cast("array<double>"))


def log_ticks(lo: Column, hi: Column, mantissas: tuple[int, ...] = (1, 2, 5), stride: int = 1) -> Column:
    """Array of mantissas times powers of ten between two positive prices."""
    decades = F.sequence(F.floor(F.log10(lo)).cast("int"), F.ceil(F.log10(hi)).cast("int"), F.lit(stride))
    all_ticks = F.flatten(F.transform(decades, lambda k: F.transform(F.array(*(F.lit(float(m)) for m in mantissas)), lambda m: m * F.pow(F.lit(10.0), k.cast("double")))))
    return F.filter(all_ticks, lambda v: (v >= lo) & (v <= hi))


def time_step(span_ns: Column, target: int) -> Column:
    """The first step of the fixed list that gives at most ``target`` ticks, or its last."""
    out = F.lit(TIME_STEPS_NS[-1])
    for s in reversed(TIME_STEPS_NS):
        out = F.when(span_ns / max(1, target) <= s, F.lit(s)).otherwise(out)
    return out


def time_ticks(lo_ns: Column, hi_ns: Column, target: int) -> Column:
    step = time_step(hi_ns - lo_ns, target)
    first, last = -floor_div(-lo_ns, step), floor_div(hi_ns, step)
    return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))


def history_columns(depth_ns: Column, dt_ns: Column) -> Column:
    """Columns of a history depth; 0 for none."""
    return F.when(depth_ns.isNull() | (depth_ns <= 0), 0).otherwise(F.greatest(F.lit(1), F.floor(depth_ns / F.when(dt_ns > 0, dt_ns).otherwise(250_000_000) + 0.5))).cast("long")


def known_band(band: Column) -> Column:
    return F.when(band.isin(*BANDS), band).otherwise(BANDS[0])


def clamped(x: Column, lo: float, hi: float, fallback: float) -> Column:
    number = x.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, float(fallback)).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), number)))
