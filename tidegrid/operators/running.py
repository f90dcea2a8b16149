"""Running values over long streams in two levels, so that no task holds a whole stream.

A stream is cut into ranges of its order. Each range is summed up in one row, these few rows are carried
forward by a window over the ranges of the stream, and the running value within a range starts from what was
carried. The rows themselves are shuffled once, by (stream, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.ints import floor_div

#: Numbers of the first order column that make one range.
RANGE = 1 << 16


def running(
    rows: DataFrame, order: tuple[str, ...], values: dict[str, tuple[str, Column]], key: str = "stream", span: int = RANGE, peers: bool = False, before: bool = False,
) -> DataFrame:
    """``rows`` with a running value for each name in ``values``, from the stream's start up to the row.

    A value is (kind, column): ``max``, ``sum`` (nulls count as 0), or ``last``, the last that is not null. The
    first column of ``order`` holds whole numbers, of which ``span`` make a range. With ``peers``, rows equal in
    order count together; with ``before``, the row itself does not count.
    """
    at = "_range"
    ranged = rows.withColumn(at, floor_div(F.col(order[0]), span))
    latest = F.struct(*order)
    whole = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), latest))}
    carry = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    earlier = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, at).agg(*(whole[kind](c).alias(f"_carry_{n}") for n, (kind, c) in values.items()))
    sums = sums.select(key, at, *(carry[kind](F.col(f"_carry_{n}")).over(earlier).alias(f"_carry_{n}") for n, (kind, _) in values.items()))
    in_range = Window.partitionBy(key, at).orderBy(*order)
    frame = in_range.rangeBetween(Window.unboundedPreceding, 0) if peers else in_range.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = ranged.join(sums, [key, at])

    def value(kind: str, c: Column, carried: Column) -> Column:
        here = carry[kind](c).over(frame)
        if kind == "sum":
            return F.when(here.isNull(), carried).otherwise(here + F.coalesce(carried, F.lit(0)))
        return F.greatest(here, carried) if kind == "max" else F.coalesce(here, carried)

    return joined.select(*rows.columns, *(value(kind, c, F.col(f"_carry_{n}")).alias(n) for n, (kind, c) in values.items()))
