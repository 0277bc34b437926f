"""Conditionals, recoding and missing values."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError
from ..expr import Between, Call, Expr, Lit, Op, Values, wrap
from ..plans.mask import LITERAL, Mask, Val, literal, literal_type, missing, nan_to_null, null_of, sizes
from ..types import common_of, common_type, kind


def scalar(name: str, operands, build, raw: bool = False) -> Call:
    return Call(name, "scalar", build, [wrap(x) for x in operands], raw)


def made(name: str, vals: list[Val], col, dtype: T.DataType) -> Val:
    return Val(col, dtype, max([v.level for v in vals], default=LITERAL), name, sizes(vals))


def _logical(v: Val, what: str):
    if kind(v.dtype) not in ("logical", "unspecified"):
        raise ExprError(f"{what} must be logical, but `{v.label}` is <{kind(v.dtype)}>.")
    return v.cast(T.BooleanType())


def is_na(x: Any) -> Call:
    """NULL, or NaN in doubles."""
    return scalar("is_na", [x], lambda mask, v: made("is_na", [v], missing(v), T.BooleanType()))


def if_else(condition: Any, true: Any, false: Any, missing: Any = None) -> Call:
    def build(mask: Mask, q: Val, *vals: Val) -> Val:
        test = _logical(q, "The condition of if_else()")
        dtype = common_of([v.dtype for v in vals], ["true", "false", "missing"])
        t, f, m = (v.cast(dtype) for v in vals)
        return made("if_else", [q, *vals], F.when(test.isNull(), m).when(test, t).otherwise(f), dtype)

    return scalar("if_else", [condition, true, false, missing], build)


def case_when(*cases: tuple[Any, Any], _default: Any = None) -> Call:
    """The value of the first case whose condition is true; a missing condition isn't."""
    if not cases or not all(isinstance(x, tuple) and len(x) == 2 for x in cases):
        raise ExprError("case_when() takes pairs (condition, value).")
    flat = [x for pair in cases for x in pair]

    def build(mask: Mask, *vals: Val) -> Val:
        *pairs, default = vals
        values = [*pairs[1::2], default]
        dtype = common_of([v.dtype for v in values], [v.label for v in values])
        col = None
        for q, v in zip(pairs[::2], pairs[1::2], strict=True):
            test = _logical(q, "A condition of case_when()")
            col = F.when(test, v.cast(dtype)) if col is None else col.when(test, v.cast(dtype))
        return made("case_when", list(vals), col.otherwise(default.cast(dtype)), dtype)

    return scalar("case_when", [*flat, _default], build)


def _listed(values: Any) -> list:
    node = wrap(values)
    items = node.values if isinstance(node, Values) else [node.value] if isinstance(node, Lit) else None
    if items is None or builtin_any(isinstance(i, Expr) for i in items):
        raise ExprError("The values to match must be plain values, not expressions.")
    return items


def builtin_any(items) -> bool:
    return next((True for i in items if i), False)


def _member(v: Val, items: list, what: str):
    """``%in%``: never missing; a missing value matches only if it is listed."""
    dtype = v.dtype
    for i in items:
        dtype = common_type(dtype, literal_type(i), v.label, what)
    known = [F.lit(i).cast(dtype) for i in items if i is not None]
    col = v.cast(dtype)
    hit = col.isin(*known) if known else F.lit(False)
    return F.when(col.isNull(), F.lit(None in items)).otherwise(hit)


def is_in(x: Any, values: Any) -> Call:
    items = _listed(values)
    return scalar("is_in", [x], lambda mask, v: made("is_in", [v], _member(v, items, "values"), T.BooleanType()))


def case_match(x: Any, *cases: tuple[Any, Any], _default: Any = None) -> Call:
    """(values, result) pairs; NULL matches only where it is listed."""
    if not cases or not all(isinstance(k, tuple) and len(k) == 2 for k in cases):
        raise ExprError("case_match() takes pairs (values, result).")
    left = [_listed(k[0]) for k in cases]

    def build(mask: Mask, v: Val, *vals: Val) -> Val:
        dtype = common_of([w.dtype for w in vals], [w.label for w in vals])
        col = None
        for items, w in zip(left, vals[:-1], strict=True):
            test = _member(v, items, "values")
            col = F.when(test, w.cast(dtype)) if col is None else col.when(test, w.cast(dtype))
        return made("case_match", [v, *vals], col.otherwise(vals[-1].cast(dtype)), dtype)

    return scalar("case_match", [x, *(k[1] for k in cases), _default], build)


def coalesce(*values: Any) -> Call:
    """The first value that isn't missing; NaN is missing."""
    if not values:
        raise ExprError("coalesce() needs at least one argument.")

    def build(mask: Mask, *vals: Val) -> Val:
        dtype = common_of([v.dtype for v in vals], [v.label for v in vals])
        return made("coalesce", list(vals), F.coalesce(*(nan_to_null(Val(v.cast(dtype), dtype)) for v in vals)), dtype)

    return scalar("coalesce", values, build)


def na_if(x: Any, y: Any) -> Call:
    """NULL where x equals y; x keeps its type."""

    def build(mask: Mask, v: Val, w: Val) -> Val:
        dtype = common_type(v.dtype, w.dtype, v.label, w.label)
        return made("na_if", [v, w], F.when(v.cast(dtype) == w.cast(dtype), null_of(v.dtype)).otherwise(v.col), v.dtype)

    return scalar("na_if", [x, y], build)


def between(x: Any, left: Any, right: Any, bounds: str = "[]") -> Between:
    return Between(wrap(x), wrap(left), wrap(right), bounds)


def near(x: Any, y: Any, tol: float = 2.0**-26) -> Expr:
    """Equal within a tolerance (by default the square root of the double's precision)."""
    from .math import abs as magnitude

    return Op("<", magnitude(Op("-", wrap(x), wrap(y))), Lit(float(tol)))


def across_names(keys: list[str], schema: T.StructType) -> T.StructType:
    return T.StructType([x for x in schema.fields if x.name not in keys])


def _if(name: str, cols: Any, fn, decisive: bool) -> Call:
    """Reads the schema when it is compiled; grouping columns take no part."""
    from ..tidyselect import resolve

    def build(mask: Mask) -> Val:
        from ..expr import Col

        vals = [mask.compile(fn(Col(n))) for n in resolve(cols, across_names(mask.groups, mask.table.schema))]
        for v in vals:
            _logical(v, f"What `{name}()` applies")
        cs = [v.cast(T.BooleanType()) for v in vals]
        col = reduce((lambda a, b: a | b) if decisive else (lambda a, b: a & b), cs) if cs else literal(not decisive)
        return made(name, vals, col, T.BooleanType())

    out = Call(name, "scalar", build, (), raw=True)
    out.selection = cols
    return out


def if_any(cols: Any, fn) -> Call:
    """Whether the condition holds in any of the columns; of none: False."""
    return _if("if_any", cols, fn, True)


def if_all(cols: Any, fn) -> Call:
    """Whether the condition holds in all of the columns; of none: True."""
    return _if("if_all", cols, fn, False)


class Across:
    """Columns times functions, expanded where it stands."""

    def __init__(self, cols: Any, fns: Any, names: str | None):
        self.cols, self.fns, self.names = cols, fns, names

    def expand(self, schema: T.StructType, keys: list[str]) -> list[tuple[str, Expr]]:
        from ..expr import Col
        from ..tidyselect import resolve, unique_names

        fns = self.fns if isinstance(self.fns, dict) else {"": self.fns}
        pattern = self.names or ("{col}_{fn}" if isinstance(self.fns, dict) else "{col}")
        out = [(pattern.format(col=n, fn=k), wrap(fn(Col(n)))) for n in resolve(self.cols, across_names(keys, schema)) for k, fn in fns.items()]
        unique_names([n for n, _ in out])
        return out


def across(cols: Any = None, fns: Any = None, names: str | None = None) -> Across:
    """``fns``: a function, or {name: function}; ``names`` may use {col} and {fn}."""
    from ..tidyselect import everything

    if fns is None:
        cols, fns = (everything(), cols) if callable(cols) or isinstance(cols, dict) else (cols, None)
    if not (callable(fns) or isinstance(fns, dict) and fns and all(map(callable, fns.values()))):
        raise ExprError("across() needs a function or a dict of functions.")
    return Across(everything() if cols is None else cols, fns, names)


def pick(*sel: Any) -> Call:
    """The selected columns as one struct; grouping columns take no part."""
    from ..plans.mask import ROW, c
    from ..tidyselect import resolve

    if not sel:
        raise ExprError("pick() needs at least one selection.")

    def build(mask: Mask) -> Val:
        schema = across_names(mask.groups, mask.table.schema)
        names = list(dict.fromkeys(n for s in sel for n in resolve(s, schema)))
        if not names:
            raise ExprError("pick() selected no columns.")
        return Val(F.struct(*(c(n) for n in names)), T.StructType([schema[n] for n in names]), ROW, "pick()")

    out = Call("pick", "row", build, (), raw=True)
    out.selection = list(sel)
    return out
