"""Lazy column expressions: ``f.x``, ``f["x"]``, literals, operators and calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from .errors import ExprError

ARITHMETIC = {"+", "-", "*", "/", "//", "%", "**"}
COMPARE = {"==", "!=", "<", "<=", ">", ">="}


class Expr:
    """A node; ``children`` are its operands, ``names()`` the columns it reads."""

    children: tuple[Expr, ...] = ()

    def names(self) -> set[str]:
        return set().union(*(c.names() for c in self.children)) if self.children else set()

    def __bool__(self):
        raise TypeError("An expression has no truth value: use & | ~ instead of and/or/not, and between() instead of a chained comparison.")

    __hash__ = object.__hash__


def _operator(symbol: str, swapped: bool = False):
    def method(self, other):
        other = wrap(other)
        return Op(symbol, other, self) if swapped else Op(symbol, self, other)

    return method


for _name, _symbol in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "&", "or": "|"}.items():
    setattr(Expr, f"__{_name}__", _operator(_symbol))
    if _symbol not in COMPARE:
        setattr(Expr, f"__r{_name}__", _operator(_symbol, swapped=True))
Expr.__invert__ = lambda self: Op("~", self)
Expr.__neg__ = lambda self: Op("-", self)


class Col(Expr):
    def __init__(self, name: str):
        self.name = name

    def names(self) -> set[str]:
        return {self.name}

    def __repr__(self):
        return f"f.{self.name}" if self.name.isidentifier() else f"f[{self.name!r}]"


class Lit(Expr):
    def __init__(self, value: Any):
        self.value = value

    def __repr__(self):
        return "NA" if self.value is None else repr(self.value)


class Values(Expr):
    """A vector given in place; in ``mutate`` it must have as many values as there are rows, or one."""

    def __init__(self, values: Sequence[Any]):
        self.values = list(values)

    def __repr__(self):
        return repr(self.values)


class Op(Expr):
    def __init__(self, op: str, *operands: Expr):
        self.op, self.children = op, operands

    def __repr__(self):
        return f"{self.op}{self.children[0]!r}" if len(self.children) == 1 else f"({self.children[0]!r} {self.op} {self.children[1]!r})"


class Call(Expr):
    """A function call.  ``build(mask, *operands)`` gets compiled operands and returns a compiled value.

    ``kind``: scalar, summary (one value per group), window (needs row order) or multi
    (any number of values, for ``reframe``).  With ``raw`` the operands stay expressions.
    """

    def __init__(self, name: str, kind: str, build: Callable, operands: Sequence[Expr] = (), raw: bool = False):
        self.name, self.kind, self.build, self.children, self.raw = name, kind, build, tuple(operands), raw

    def __repr__(self):
        return f"{self.name}({', '.join(map(repr, self.children))})"


class Descending(Expr):
    def __init__(self, inner: Expr):
        self.children = (inner,)

    def __repr__(self):
        return f"desc({self.children[0]!r})"


class Between(Expr):
    """``between()``: a condition on rows, or in ``join_by`` a range."""

    def __init__(self, x: Expr, left: Expr, right: Expr, bounds: str):
        if bounds not in ("[]", "[)", "(]", "()"):
            raise ExprError(f"`bounds` must be one of [] [) (] (), not {bounds!r}.")
        self.children, self.bounds = (x, left, right), bounds

    def condition(self) -> Expr:
        x, left, right = self.children
        return Op("&", Op(">=" if self.bounds[0] == "[" else ">", x, left), Op("<=" if self.bounds[1] == "]" else "<", x, right))

    def __repr__(self):
        return "between({!r}, {!r}, {!r})".format(*self.children)


class NameRange(Expr):
    """``f["a":"c"]``: columns from one to another."""

    def __init__(self, start: str | None, stop: str | None):
        self.start, self.stop = start, stop

    def __repr__(self):
        return f"f[{self.start!r}:{self.stop!r}]"


class _Columns:
    """``f``: attribute or item access makes a column reference."""

    def __getattr__(self, name: str) -> Col:
        if name.startswith("__"):
            raise AttributeError(name)
        return Col(name)

    def __getitem__(self, name) -> Expr:
        if isinstance(name, slice):
            if name.step is not None:
                raise ExprError("A column range has no step.")
            end = lambda v: v.name if isinstance(v, Col) else v
            return NameRange(end(name.start), end(name.stop))
        return Col(name)

    def __repr__(self):
        return "f"


f = _Columns()
NA = Lit(None)


def wrap(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, (list, tuple, range)):
        return Values(value)
    return Lit(value)


def walk(expr: Expr):
    yield expr
    for c in expr.children:
        yield from walk(c)
