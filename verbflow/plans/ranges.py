"""Joins on ranges alone, binned: an equi-join on buckets instead of a nested loop.

Spark would compare every pair.  ``x.a >= y.b`` and ``x.c <= y.d`` can hold only where the
interval between a and c touches the one between b and d, whichever ends are larger: a
point in an interval, an interval within another and overlaps are all of this form.  Both
sides are dealt into buckets on levels whose width grows fourfold; an interval's own level is
the first one where it touches few buckets.  A pair meets on the higher of its two levels,
in the bucket where the later of the two intervals begins, and nowhere else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import c, hidden

#: How much wider the buckets of the next level are.
STEP = 4.0

#: An interval touches at most so many buckets of its own level, and of any higher one.
MOST_BUCKETS = 5


def _number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(col)).cast("double") if hasattr(F, "to_timestamp_ltz") else F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("double")


def _test(op: str, a: Column, b: Column) -> Column:
    return {">=": a >= b, ">": a > b, "<=": a <= b, "<": a < b}[op]


def _lengths(df: DataFrame, start: Column, stop: Column) -> tuple[float, float, float, float]:
    """Median and greatest length, greatest finite value, and whether (1.0) an end is infinite: one small aggregate."""
    reach = F.greatest(F.abs(start), F.abs(stop))
    finite = reach < float("inf")
    row = df.agg(F.percentile_approx(F.when(finite, stop - start), 0.5), F.max(F.when(finite, stop - start)), F.max(F.when(finite, reach)), F.max((~finite).cast("double"))).first()
    return tuple(v or 0.0 for v in row)


def range_pairs(x: DataFrame, y: DataFrame, on: list[tuple[str, str, str, T.DataType]]) -> DataFrame | None:
    """Pairs for conditions (op, x column, y column, type); None if they don't bound each other from both sides.

    NULL and NaN satisfy no condition; infinite ends do, as the largest or smallest value.
    """
    lower = [q for q in on if q[0] in (">=", ">")]
    upper = [q for q in on if q[0] in ("<=", "<")]
    if not lower or not upper:
        return None
    sharing = ((a, b) for a in lower for b in upper if a[1] == b[1] or a[2] == b[2])
    low, high = next(sharing, (lower[0], upper[0]))
    numeric = isinstance(low[3], T.NumericType) and isinstance(high[3], T.NumericType)
    if not numeric and (low[3] != high[3] or not isinstance(low[3], (T.DateType, T.TimestampType, T.TimestampNTZType))):
        return None
    condition = reduce(lambda a, b: a & b, [_test(op, c(a), c(b)) for op, a, b, _ in on])
    ends = {"x": (_number(c(low[1]), low[3]), _number(c(high[1]), high[3])), "y": (_number(c(low[2]), low[3]), _number(c(high[2]), high[3]))}
    sides = {"x": x, "y": y}
    sides = {k: df.where(reduce(lambda a, b: a & b, [e.isNotNull() & ~F.isnan(e) for e in ends[k]])) for k, df in sides.items()}
    spans = {k: (F.least(*e), F.greatest(*e)) for k, e in ends.items()}
    points = {"x": low[1] == high[1], "y": low[2] == high[2]}
    if all(points.values()):
        return None
    found = {k: _lengths(sides[k], *spans[k]) for k in sides if not points[k]}
    typical, longest, most, infinite = (max(v) for v in zip(*found.values(), strict=True))
    for k in points:
        if points[k] and infinite:
            most = max(most, _lengths(sides[k], *spans[k])[2])
        elif points[k]:  # beyond all intervals
            sides[k] = sides[k].where(F.abs(spans[k][0]) <= most)
    width = max(typical, most / 2**40) or 1.0
    edge = max(most, width)
    longest = 2 * edge if infinite else longest
    reach, levels = width * (MOST_BUCKETS - 1), 0
    while reach * STEP**levels < longest:
        levels += 1

    level, bucket = hidden(), hidden()
    dealt, own, first = {}, {}, {}
    for k, df in sides.items():
        # infinite ends lie beside the largest finite ones; the conditions tell them apart
        start, stop = (F.greatest(F.least(e, F.lit(edge)), F.lit(-edge)) for e in spans[k])
        length = stop - start
        mine = F.least(F.lit(levels), F.when(length <= reach, 0).otherwise(F.ceil(F.log(length / reach) / F.log(F.lit(STEP))))).cast("int")
        own[k], first[k] = hidden(), hidden()
        size = F.lit(width) * F.pow(F.lit(STEP), c(level))
        dealt[k] = (
            df.withColumn(own[k], mine)
            .withColumn(level, F.explode(F.sequence(c(own[k]), F.lit(levels))))
            .withColumn(first[k], F.floor(start / size))
            .withColumn(bucket, F.explode(F.sequence(c(first[k]), F.floor(stop / size))))
        )
    here = (c(level) == F.greatest(c(own["x"]), c(own["y"]))) & (c(bucket) == F.greatest(c(first["x"]), c(first["y"])))
    return dealt["x"].join(dealt["y"], [level, bucket]).where(condition & here).drop(level, bucket, *own.values(), *first.values())
