"""Summary functions: one value per group, NA-poisoned unless ``na_rm``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError
from ..expr import Call, wrap
from ..plans.mask import Mask, Val, missing, nan_to_null, null_of, numeric
from ..types import common_type, kind


def summary(name: str, operands, build) -> Call:
    return Call(name, "summary", build, [wrap(x) for x in operands])


def _clean(v: Val, na_rm: bool) -> Column:
    return nan_to_null(v) if na_rm else v.col


def _guard(mask: Mask, bad: Column, value: Column, dtype: T.DataType) -> Column:
    """NA if ``bad`` holds in any row of the group; both aggregates run in the same pass."""
    return F.when(mask.agg(F.max(bad.cast("int"))) == 1, null_of(dtype)).otherwise(value)


def n() -> Call:
    """Rows in the group."""
    return summary("n", [], lambda mask: mask.summarised("n()", mask.agg(F.count(F.lit(1))), T.LongType()))


def mean(x: Any, na_rm: bool = False) -> Call:
    def build(mask: Mask, v: Val) -> Val:
        v = numeric(v, "mean()")
        value = mask.agg(F.avg(_clean(v, na_rm).cast("double")))
        return mask.summarised("mean", value if na_rm else _guard(mask, v.col.isNull(), value, T.DoubleType()), T.DoubleType())

    return summary("mean", [x], build)


def sum(x: Any, na_rm: bool = False) -> Call:  # noqa: A001
    """Of nothing: 0.  Logicals and integers give bigint."""

    def build(mask: Mask, v: Val) -> Val:
        v = numeric(v, "sum()")
        dtype = T.LongType() if kind(v.dtype) == "integer" else T.DoubleType()
        value = F.coalesce(mask.agg(F.sum(_clean(v, na_rm).cast(dtype))), F.lit(0).cast(dtype))
        return mask.summarised("sum", value if na_rm else _guard(mask, v.col.isNull(), value, dtype), dtype)

    return summary("sum", [x], build)


def _extreme(name: str, x: Any, na_rm: bool) -> Call:
    def build(mask: Mask, v: Val) -> Val:
        if kind(v.dtype) == "logical":
            v = numeric(v, name)
        if kind(v.dtype) in ("list", "struct"):
            raise ExprError(f"`{name}()` needs values that have an order, but `{v.label}` is <{kind(v.dtype)}>.")
        value = mask.agg((F.min if name == "min" else F.max)(_clean(v, na_rm)))
        if not na_rm:
            if name == "min" and isinstance(v.dtype, (T.DoubleType, T.FloatType)):
                value = F.when(mask.agg(F.max(F.isnan(v.col).cast("int"))) == 1, F.lit(float("nan")).cast(v.dtype)).otherwise(value)
            value = _guard(mask, v.col.isNull(), value, v.dtype)
        return mask.summarised(name, value, v.dtype)

    return summary(name, [x], build)


def min(x: Any, na_rm: bool = False) -> Call:  # noqa: A001
    return _extreme("min", x, na_rm)


def max(x: Any, na_rm: bool = False) -> Call:  # noqa: A001
    return _extreme("max", x, na_rm)


def _numbers(name: str, x: Any, na_rm: bool, value) -> Call:
    """Statistics for which NaN is missing as NULL is."""

    def build(mask: Mask, v: Val) -> Val:
        v = numeric(v, f"{name}()")
        out = value(mask, nan_to_null(v).cast("double"))
        return mask.summarised(name, out if na_rm else _guard(mask, missing(v), out, T.DoubleType()), T.DoubleType())

    return summary(name, [x], build)


def median(x: Any, na_rm: bool = False) -> Call:
    return _numbers("median", x, na_rm, lambda m, v: m.agg(F.percentile(v, F.lit(0.5))))


def sd(x: Any, na_rm: bool = False) -> Call:
    return _numbers("sd", x, na_rm, lambda m, v: m.agg(F.stddev_samp(v)))


def var(x: Any, na_rm: bool = False) -> Call:
    return _numbers("var", x, na_rm, lambda m, v: m.agg(F.var_samp(v)))


def IQR(x: Any, na_rm: bool = False) -> Call:
    def value(mask: Mask, v: Column) -> Column:
        q = mask.agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))))
        return q[1] - q[0]

    return _numbers("IQR", x, na_rm, value)


def quantile(x: Any, probs: float | list[float], na_rm: bool = False) -> Call:
    """Linear interpolation (R's type 7).  Several probabilities give several values: for ``reframe``."""
    several = isinstance(probs, (list, tuple))
    wanted = list(probs) if several else [probs]
    for p in wanted:
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise ExprError(f"quantile(): `probs` must lie between 0 and 1, not {p!r}.")
    if not several:
        return _numbers("quantile", x, na_rm, lambda m, v: m.agg(F.percentile(v, F.lit(float(probs)))))

    def build(mask: Mask, v: Val) -> Val:
        v = numeric(v, "quantile()")
        q = mask.agg(F.percentile(nan_to_null(v).cast("double"), F.array(*(F.lit(float(p)) for p in wanted))))
        empty = F.array_repeat(null_of(T.DoubleType()), len(wanted))
        out = F.coalesce(q, empty)
        if not na_rm:
            out = F.when(mask.agg(F.max(missing(v).cast("int"))) == 1, empty).otherwise(out)
        return mask.summarised("quantile", out, T.DoubleType(), "many")

    return Call("quantile", "multi", build, [wrap(x)])


def mad(x: Any, center: Any = None, constant: float = 1.4826, na_rm: bool = False) -> Call:
    """constant * median(abs(x - center)); the center is the group's median unless given."""
    centre = wrap(center) if center is not None else median(x, na_rm=na_rm)

    def build(mask: Mask, v: Val, m: Val) -> Val:
        v, m = numeric(v, "mad()"), numeric(m, "mad()")
        at = m.col if m.size == "one" else mask.rows(lambda: mask.flat(Val(mask.agg(F.min_by(m.col, mask.position())), m.dtype, 2))).col
        value = mask.agg(F.percentile(F.abs(nan_to_null(v).cast("double") - at), F.lit(0.5))) * constant
        return mask.summarised("mad", value if na_rm else _guard(mask, missing(v), value, T.DoubleType()), T.DoubleType())

    return summary("mad", [x, centre], build)


def _logic(name: str, x: Any, na_rm: bool) -> Call:
    decisive = name == "any"

    def build(mask: Mask, v: Val) -> Val:
        if kind(v.dtype) not in ("logical", "unspecified"):
            raise ExprError(f"`{name}()` needs logical values, but `{v.label}` is <{kind(v.dtype)}>.")
        x = v.cast(T.BooleanType())
        value = F.coalesce(mask.agg((F.bool_or if decisive else F.bool_and)(x)), F.lit(not decisive))
        if not na_rm:
            unknown = mask.agg(F.max(x.isNull().cast("int"))) == 1
            value = F.when(value == decisive, value).when(unknown, null_of(T.BooleanType())).otherwise(value)
        return mask.summarised(name, value, T.BooleanType())

    return summary(name, [x], build)


def any(x: Any, na_rm: bool = False) -> Call:  # noqa: A001
    """True if one is; else NA if one is missing; else (and of nothing) False."""
    return _logic("any", x, na_rm)


def all(x: Any, na_rm: bool = False) -> Call:  # noqa: A001
    """False if one is; else NA if one is missing; else (and of nothing) True."""
    return _logic("all", x, na_rm)


def _end(name: str, x: Any, default: Any, na_rm: bool) -> Call:
    def build(mask: Mask, v: Val, d: Val) -> Val:
        dtype = common_type(v.dtype, d.dtype, v.label, "default")
        at = mask.sequence()
        value = F.struct(v.cast(dtype).alias("v"))
        if na_rm:
            value, at = F.when(~missing(v), value), F.when(~missing(v), at)
        found = mask.agg((F.min_by if name == "first" else F.max_by)(value, at))
        return mask.summarised(name, F.when(found.isNull(), d.cast(dtype)).otherwise(found["v"]), dtype)

    return summary(name, [x, default], build)


def first(x: Any, default: Any = None, na_rm: bool = False) -> Call:
    return _end("first", x, default, na_rm)


def last(x: Any, default: Any = None, na_rm: bool = False) -> Call:
    return _end("last", x, default, na_rm)


def nth(x: Any, n: int, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Call:
    """The n-th value from 1, or from the end if negative, in row order or by ``order_by`` (missing last)."""
    if isinstance(n, bool) or not isinstance(n, int) or n == 0:
        raise ExprError("nth(): `n` must be an integer other than 0.")
    operands = [x, default] + ([order_by] if order_by is not None else [])

    def build(mask: Mask, v: Val, d: Val, *by: Val) -> Val:
        dtype = common_type(v.dtype, d.dtype, v.label, "default")
        # rows are numbered from the end that n counts from, and only the n-th is carried on
        first = [nan_to_null(by[0]).asc_nulls_last() if n > 0 else nan_to_null(by[0]).desc_nulls_first()] if by else []
        at = mask.rows(lambda: mask.add(F.row_number().over(mask.ordered(first, [missing(v)] if na_rm else [], backwards=n < 0))))
        wanted = (at == abs(n)) & ~missing(v) if na_rm else at == abs(n)
        found = mask.agg(F.any_value(F.when(wanted, F.struct(v.cast(dtype).alias("v"))), F.lit(True)))
        return mask.summarised("nth", F.when(found.isNull(), d.cast(dtype)).otherwise(found["v"]), dtype)

    return summary("nth", operands, build)


def n_distinct(*xs: Any, na_rm: bool = False) -> Call:
    """Distinct values or combinations; missing (NULL or NaN) is one value, or with ``na_rm`` no value."""
    if not xs:
        raise ExprError("n_distinct() needs at least one argument.")

    def build(mask: Mask, *vals: Val) -> Val:
        parts: list[Column] = []
        for v in vals:
            if isinstance(v.dtype, T.StructType):
                parts += [nan_to_null(Val(v.col[x.name], x.dataType)) for x in v.dtype.fields]
            else:
                parts.append(nan_to_null(v))
        item = F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts)))
        if na_rm:
            whole = parts[0].isNotNull()
            for p in parts[1:]:
                whole = whole & p.isNotNull()
            item = F.when(whole, item)
        if mask.mode == "agg":
            value = F.count_distinct(item)
        else:
            value = F.size(mask.agg(F.collect_set(item)))
        return mask.summarised("n_distinct", value.cast("bigint"), T.LongType())

    return summary("n_distinct", xs, build)
