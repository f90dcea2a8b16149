"""Fixed schemas of the canonical streams. Timestamps are nanoseconds in 64 bits; sides and sources are codes."""

from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_LEVELS = ArrayType(StructType([StructField("price", DoubleType()), StructField("amount", DoubleType())]))
_TYPES: dict[str, DataType] = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "array<double>": ArrayType(DoubleType()), "levels": _LEVELS}


def _schema(fields: str) -> StructType:
    """A schema from "name type, ..."; it needs no session, unlike Spark's own parser."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


#: Side of a trade, and where the side comes from.
BUY, SELL, UNKNOWN = 0, 1, 2
FROM_EXCHANGE, INFERRED, NOT_KNOWN = 0, 1, 2
#: Kinds of markers.
MARKER_KINDS = ("liquidation", "halt", "luld", "gap", "session_break", "large_lot", "iceberg", "info")

TRADE = _schema("stream string, seq long, ts_ns long, price double, size double, side int, side_src int, venue string")
LEVEL = _schema("stream string, seq long, ts_ns long, side int, price double, size double")
BOOK = _schema("stream string, seq long, ts_ns long, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>")
BBO = _schema("stream string, seq long, ts_ns long, bid_px double, bid_sz double, ask_px double, ask_sz double")
MARKER = _schema("stream string, seq long, ts_ns long, kind string, text string, price double, size double")
EPOCH = _schema(
    "stream string, epoch int, tick double, tick_multiple int, dt_ns long, p0 double, rows int, scale_kind int, "
    "dn_rows int, core_rows int, core_p0 double, core_step double, lo_price double, hi_price double"
)
CELL = _schema("stream string, epoch int, col_seq long, t0_ns long, row int, bid double, ask double")
BAR = _schema(
    "stream string, epoch int, col_seq long, t0_ns long, o double, h double, l double, c double, vol_buy double, vol_sell double, "
    "cvd_cum double, vwap_num_cum double, vwap_den_cum double"
)
CANDLE = _schema("stream string, t0_ns long, o double, h double, l double, c double, volume double, buy_volume double, sell_volume double")
EXCHANGE_RECORD = _schema(
    "stream string, seq long, kind string, source_ts long, local_ts long, bids levels, "
    "asks levels, price double, amount double, side string, id string"
)
