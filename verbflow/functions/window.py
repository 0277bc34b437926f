"""Window functions: a value per row that depends on row order or rank within the group."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError
from ..expr import Call, Descending, Expr, wrap
from ..plans.mask import Mask, Val, missing, nan_to_null, null_of, numeric
from ..types import common_type, kind


def _shift(name: str, x: Any, n: int, default: Any, order_by: Any) -> Call:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ExprError(f"{name}(): `n` must be an integer of 0 or more.")
    operands = [wrap(x), wrap(default)] + ([wrap(order_by)] if order_by is not None else [])

    def build(mask: Mask, v: Val, d: Val, *by: Val) -> Val:
        dtype = common_type(v.dtype, d.dtype, v.label, "default")
        over = mask.ordered([nan_to_null(by[0]).asc_nulls_last()] if by else [])
        moved = (F.lag if name == "lag" else F.lead)(F.struct(v.cast(dtype).alias("v")), n).over(over) if n else F.struct(v.cast(dtype).alias("v"))
        return mask.windowed(name, F.when(moved.isNull(), d.cast(dtype)).otherwise(moved["v"]), dtype)

    return Call(name, "window", build, operands)


def lag(x: Any, n: int = 1, default: Any = None, order_by: Any = None) -> Call:
    """The value ``n`` rows before, in row order or by ``order_by``; ``default`` beyond the edge."""
    return _shift("lag", x, n, default, order_by)


def lead(x: Any, n: int = 1, default: Any = None, order_by: Any = None) -> Call:
    """The value ``n`` rows after, in row order or by ``order_by``; ``default`` beyond the edge."""
    return _shift("lead", x, n, default, order_by)


def _ranked(mask: Mask, x: Expr) -> tuple[Column, Column]:
    """Sort key and missingness of what is ranked: a column, desc() of one, or pick()."""
    down = isinstance(x, Descending)
    v = mask.rows(lambda: mask.flat(mask.compile(x.children[0] if down else x)))
    if isinstance(v.dtype, T.StructType):
        parts = [Val(v.col[p.name], p.dataType) for p in v.dtype.fields]
        gone = missing(parts[0])
        for p in parts[1:]:
            gone = gone | missing(p)
    else:
        gone = missing(v)
    return (v.col.desc() if down else v.col.asc()), gone


def _rank(name: str, x: Any, value, dtype: T.DataType, ties: bool = True) -> Call:
    def build(mask: Mask, node: Expr) -> Val:
        key, gone = _ranked(mask, node)
        if ties:
            mask.whole()  # fixes the row order
            over = Window.partitionBy(*mask.keys(), gone).orderBy(key)
        else:
            over = mask.ordered([key], [gone])
        count = F.count(F.lit(1)).over(Window.partitionBy(*mask.keys(), gone))
        return mask.windowed(name, F.when(~gone, value(over, count)).cast(dtype), dtype)

    return Call(name, "window", build, [wrap(x)], raw=True)


def row_number(x: Any = None) -> Call:
    """Position in the group; with ``x`` the ordinal rank, ties by position."""
    if x is None:
        return Call("row_number", "window", lambda mask: mask.windowed("row_number", F.row_number().over(mask.ordered()).cast("bigint"), T.LongType()))
    return _rank("row_number", x, lambda w, n: F.row_number().over(w), T.LongType(), ties=False)


def min_rank(x: Any) -> Call:
    return _rank("min_rank", x, lambda w, n: F.rank().over(w), T.LongType())


def dense_rank(x: Any) -> Call:
    return _rank("dense_rank", x, lambda w, n: F.dense_rank().over(w), T.LongType())


def percent_rank(x: Any) -> Call:
    """(min_rank - 1) / (n - 1); of a single value NaN."""
    return _rank("percent_rank", x, lambda w, n: F.when(n == 1, F.lit(float("nan"))).otherwise(F.try_divide(F.rank().over(w) - 1, n - 1)), T.DoubleType())


def cume_dist(x: Any) -> Call:
    return _rank("cume_dist", x, lambda w, n: F.cume_dist().over(w), T.DoubleType())


def ntile(x: Any, n: int) -> Call:
    """``n`` buckets of about equal size, the first ones larger."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ExprError("ntile(): `n` must be a positive integer.")
    return _rank("ntile", x, lambda w, _: F.ntile(n).over(w), T.LongType(), ties=False)


def consecutive_id(*xs: Any) -> Call:
    """Number of the run of equal values, from 1."""
    if not xs:
        raise ExprError("consecutive_id() needs at least one argument.")

    def build(mask: Mask, *vals: Val) -> Val:
        over = mask.ordered()
        item = F.struct(*(v.col.alias(f"c{i}") for i, v in enumerate(vals)))
        new = mask.add(F.when(F.row_number().over(over) == 1, 1).otherwise((~item.eqNullSafe(F.lag(item).over(over))).cast("int")))
        return mask.windowed("consecutive_id", F.sum(new).over(mask.running()), T.LongType())

    return Call("consecutive_id", "window", build, [wrap(x) for x in xs])


def _cumulative(name: str, x: Any, value) -> Call:
    def build(mask: Mask, v: Val) -> Val:
        v = numeric(v, f"{name}()")
        over = mask.running()
        out, dtype = value(v, over)
        known = F.max(v.col.isNull().cast("int")).over(over) == 0
        return mask.windowed(name, F.when(known, out).cast(dtype), dtype)

    return Call(name, "window", build, [wrap(x)])


def cumsum(x: Any) -> Call:
    def value(v, over):
        dtype = T.LongType() if kind(v.dtype) == "integer" else T.DoubleType()
        return F.sum(v.cast(dtype)).over(over), dtype

    return _cumulative("cumsum", x, value)


def cummean(x: Any) -> Call:
    return _cumulative("cummean", x, lambda v, over: (F.avg(v.col.cast("double")).over(over), T.DoubleType()))


def cummin(x: Any) -> Call:
    return _cumulative("cummin", x, lambda v, over: (F.min(v.col).over(over), v.dtype))


def cummax(x: Any) -> Call:
    return _cumulative("cummax", x, lambda v, over: (F.max(v.col).over(over), v.dtype))


def _cumulative_logic(name: str, x: Any) -> Call:
    decisive = name == "cumany"

    def build(mask: Mask, v: Val) -> Val:
        if kind(v.dtype) not in ("logical", "unspecified"):
            raise ExprError(f"`{name}()` needs logical values, but `{v.label}` is <{kind(v.dtype)}>.")
        over, x = mask.running(), v.cast(T.BooleanType())
        so_far = F.coalesce((F.bool_or if decisive else F.bool_and)(x).over(over), F.lit(not decisive))
        unknown = F.max(x.isNull().cast("int")).over(over) == 1
        return mask.windowed(name, F.when(so_far == decisive, so_far).when(unknown, null_of(T.BooleanType())).otherwise(so_far), T.BooleanType())

    return Call(name, "window", build, [wrap(x)])


def cumall(x: Any) -> Call:
    return _cumulative_logic("cumall", x)


def cumany(x: Any) -> Call:
    return _cumulative_logic("cumany", x)


def desc(x: Any) -> Descending:
    """Descending order in ``arrange`` and ranks; elsewhere the negated number."""
    return Descending(wrap(x))
