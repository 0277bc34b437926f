"""The data mask: compiles expressions to Spark columns, with types checked before Spark sees them.

A compiled value has a level: literal < row < window < aggregate.  Spark takes no window
or aggregate under another one, so what stands under one is *hoisted*: computed as a
hidden column of the mask's DataFrame first.  Ungrouped summaries in row context become a
one-row aggregate that is broadcast to the rows, not a window over a single partition.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError
from ..expr import ARITHMETIC, COMPARE, Between, Call, Col, Descending, Expr, Lit, NameRange, Op, Values, wrap
from ..table import Table, c, hidden
from ..types import common_of, common_type, kind

LITERAL, ROW, WINDOW, AGGREGATE = range(4)


@dataclass
class Val:
    col: Column
    dtype: T.DataType
    level: int = ROW
    label: str = "x"
    #: "one" value per group, one per row ("n"), or an array of any number ("many")
    size: str = "n"

    def cast(self, dtype: T.DataType) -> Column:
        return self.col if self.dtype == dtype else self.col.cast(dtype)


def null_of(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def fail(message: str, dtype: T.DataType) -> Column:
    return F.raise_error(F.lit(message)).cast(dtype)


def missing(v: Val) -> Column:
    """NULL, or NaN in doubles."""
    if isinstance(v.dtype, (T.DoubleType, T.FloatType)):
        return v.col.isNull() | F.isnan(v.col)
    return v.col.isNull()


def nan_to_null(v: Val) -> Column:
    if isinstance(v.dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(v.col), null_of(v.dtype)).otherwise(v.col)
    return v.col


def mirrored(v: Val) -> list[Column] | None:
    """Keys whose rising order is the falling order of the value (NaN first), or None."""
    match v.dtype:
        case T.BooleanType():
            return [~v.col]
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return [F.bitwise_not(v.col)]
        case T.FloatType() | T.DoubleType():
            return [~F.isnan(v.col), -v.col]
        case T.DecimalType():
            return [-v.col]
        case T.DateType():
            return [-F.unix_date(v.col)]
        case T.TimestampType():
            return [-F.unix_micros(v.col)]
    return None


def literal_type(value) -> T.DataType:
    match value:
        case None:
            return T.NullType()
        case bool():
            return T.BooleanType()
        case int():
            return T.LongType()
        case float():
            return T.DoubleType()
        case str():
            return T.StringType()
        case datetime.datetime():
            return T.TimestampNTZType() if value.tzinfo is None else T.TimestampType()
        case datetime.date():
            return T.DateType()
        case datetime.timedelta():
            return T.DayTimeIntervalType()
        case decimal.Decimal():
            return T.DoubleType()
    raise ExprError(f"`{value!r}` can't be a value in an expression.")


def literal(value) -> Column:
    dtype = literal_type(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return F.lit(value).cast(dtype)


class Mask:
    def __init__(self, table: Table, groups: list[str] | None = None, mode: str = "window"):
        self.table = table
        self.groups = table.groups if groups is None else list(groups)
        self.mode = mode
        self.earlier: dict[str, tuple[Expr, dict]] = {}
        self.made: list[str] = []
        #: a frame, its ungrouped aggregates so far, and the frame with them
        self.ungrouped: tuple = (None, [], None)

    # the frame and its windows
    @property
    def df(self):
        return self.table.df

    def keys(self) -> list[Column]:
        return [c(g) for g in self.groups]

    def whole(self) -> WindowSpec:
        """All rows of a group; the shuffle it takes would lose a row order that isn't written down."""
        self.table = self.table.with_order()
        return Window.partitionBy(*self.keys())

    def ordered(self, first: list[Column] = (), split: list[Column] = (), backwards: bool = False) -> WindowSpec:
        """Rows of a group by ``first``, then in row order or against it."""
        self.table = self.table.with_order()
        if backwards:
            by = [c(n).desc_nulls_first() if up else c(n).asc_nulls_first() for n, up in self.table.order]
        else:
            by = self.table.order_columns()
        return Window.partitionBy(*self.keys(), *split).orderBy(*first, *by)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def add(self, col: Column) -> Column:
        name = hidden()
        self.table = self.table.but(self.df.withColumn(name, col))
        self.made.append(name)
        return c(name)

    def flat(self, v: Val) -> Val:
        """The value as something that may stand under a window or an aggregate."""
        return replace(v, col=self.add(v.col), level=ROW) if v.level >= WINDOW else v

    def agg(self, col: Column) -> Column:
        """An aggregate per group: as such when summarising, otherwise brought to the rows."""
        if self.mode == "agg":
            return col
        if self.groups:
            return col.over(self.whole())
        name = hidden()
        self.table = self.table.but(self._beside(col.alias(name)))
        self.made.append(name)
        return c(name)

    def _beside(self, col: Column):
        """The rows with an ungrouped aggregate; those of one frame are one aggregate, read once.

        A value that rests on an earlier one has to wait for it, which analysis tells.
        """
        base, cols, made = self.ungrouped
        if made is self.df:
            try:
                row = base.agg(*cols, col)
            except AnalysisException:
                pass
            else:
                made = base.crossJoin(F.broadcast(row))
                self.ungrouped = base, [*cols, col], made
                return made
        base = self.df
        self.ungrouped = base, [col], base.crossJoin(F.broadcast(base.agg(col)))
        return self.ungrouped[2]

    def summarised(self, label: str, col: Column, dtype: T.DataType, size: str = "one") -> Val:
        return Val(col, dtype, AGGREGATE if self.mode == "agg" else WINDOW if self.groups else ROW, label, size)

    def windowed(self, label: str, col: Column, dtype: T.DataType) -> Val:
        return Val(col, dtype, WINDOW, label)

    def rows(self, work: Callable):
        """Run ``work`` in row context (arguments of summaries)."""
        mode, self.mode = self.mode, "window"
        try:
            return work()
        finally:
            self.mode = mode

    def position(self) -> Column:
        """A hidden column that numbers the rows of each group in row order."""
        return self.add(F.row_number().over(self.ordered()))

    def sequence(self) -> Column:
        """A value that grows in row order, for min_by and max_by: no window has to number the rows.

        A falling key takes its mirror image; where a type has none, the rows are numbered.
        """
        self.table = self.table.with_order()
        parts: list[Column] = []
        for name, up in self.table.order:
            key = Val(c(name), self.df.schema[name].dataType)
            if not up:
                if (down := mirrored(key)) is None:
                    return self.rows(self.position)
                parts += [key.col.isNull(), *down]
            else:
                parts += [key.col.isNull(), key.col]
        return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))) if parts else self.rows(self.position)

    # expressions
    def compile(self, expr) -> Val:
        expr = wrap(expr)
        match expr:
            case Col(name=name):
                if name in self.earlier:
                    return self._earlier(name)
                fields = {x.name: x.dataType for x in self.table.schema.fields}
                if name not in fields:
                    raise ExprError(f"Column `{name}` not found.")
                return Val(c(name), fields[name], ROW, name)
            case Lit(value=value):
                return Val(literal(value), literal_type(value), LITERAL, repr(expr), "one")
            case Values():
                return self._values(expr)
            case Op():
                return self._op(expr)
            case Between():
                return self.compile(expr.condition())
            case Descending(children=(inner,)):
                return replace(self._op(Op("-", inner)), label=repr(expr))
            case Call():
                if expr.raw:
                    return expr.build(self, *expr.children)
                if expr.kind in ("summary", "window", "multi"):
                    operands = self.rows(lambda: [self.flat(self.compile(x)) for x in expr.children])
                else:
                    operands = [self.compile(x) for x in expr.children]
                out = expr.build(self, *operands)
                return out if isinstance(out, Val) else self._foreign(expr, operands, out)
        if isinstance(expr, NameRange) or type(expr).__name__ == "Selector":
            raise ExprError(f"`{expr!r}` selects columns and can't be used as a value; see across() and pick().")
        raise ExprError(f"`{expr!r}` can't be used here.")

    def _foreign(self, expr: Call, operands: list[Val], col: Column) -> Val:
        """A user's own function that returned a bare Column: Spark tells its type."""
        sample = self.df.limit(0)
        dtype = (sample.agg(col.alias("x")) if expr.kind == "summary" else sample.select(col.alias("x"))).schema[0].dataType
        if expr.kind == "summary":
            return self.summarised(repr(expr), self.agg(col), dtype)
        if expr.kind == "multi":
            return self.summarised(repr(expr), self.agg(col), dtype.elementType, "many")
        level = max([v.level for v in operands], default=LITERAL)
        return Val(col, dtype, WINDOW if expr.kind == "window" else level, repr(expr), "n" if expr.kind == "window" else sizes(operands))

    def _earlier(self, name: str) -> Val:
        """An earlier result of the same summarise(): a scalar of the group."""
        expr, env = self.earlier[name]
        now, self.earlier = self.earlier, env
        try:
            v = self.summary_item(expr) if self.mode == "agg" else self.compile(expr)
        finally:
            self.earlier = now
        return replace(v, label=name)

    def is_summary(self, expr: Expr) -> bool:
        """Whether the expression has one value per group by its form."""
        match expr:
            case Lit():
                return True
            case Col(name=name):
                return name in self.earlier
            case Values():
                return len(expr.values) == 1
            case Call(kind="summary"):
                return True
            case Call(kind="scalar", raw=False) | Op() | Between() | Descending():
                return all(self.is_summary(x) for x in expr.children)
            case Call(kind="scalar", raw=True):
                return bool(expr.children) and all(self.is_summary(x) for x in expr.children)
        return False

    def summary_item(self, expr) -> Val:
        """One value per group.  A value per row is accepted where every group has one row."""
        expr = wrap(expr)
        if isinstance(expr, Call) and expr.kind == "multi":
            raise ExprError(f"`{expr!r}` must have size 1; use reframe() for several values per group.")
        if self.is_summary(expr):
            return self.compile(expr)
        v = self.rows(lambda: self.flat(self.compile(expr)))
        one = F.count(F.lit(1)) == 1
        hint = f"`{expr!r}` must have size 1 in every group; use reframe() for several values per group."
        return Val(F.when(one, F.first(v.col)).otherwise(fail(hint, v.dtype)), v.dtype, AGGREGATE, v.label, "one")

    def _values(self, expr: Values) -> Val:
        dtype = common_of([literal_type(x) for x in expr.values] or [T.NullType()], [repr(x) for x in expr.values] or ["NULL"])
        items = [F.lit(x).cast(dtype) for x in expr.values]
        if len(items) == 1:
            return Val(items[0], dtype, LITERAL, repr(expr), "one")
        row = F.row_number().over(self.ordered())
        size = self.agg(F.count(F.lit(1)))
        bad = fail(f"A vector of {len(items)} values needs as many rows in every group.", dtype)
        return Val(F.when(size == len(items), F.try_element_at(F.array(*items), row)).otherwise(bad), dtype, WINDOW, repr(expr))

    def _op(self, expr: Op) -> Val:
        args = [self.compile(x) for x in expr.children]
        level, label, size = max(a.level for a in args), repr(expr), sizes(args)
        if expr.op in ("&", "|", "~"):
            for a in args:
                if kind(a.dtype) not in ("logical", "unspecified"):
                    raise ExprError(f"`{expr.op}` needs logical values, but `{a.label}` is <{kind(a.dtype)}>.")
            x = [a.cast(T.BooleanType()) for a in args]
            col = ~x[0] if expr.op == "~" else x[0] & x[1] if expr.op == "&" else x[0] | x[1]
            return Val(col, T.BooleanType(), level, label, size)
        if expr.op in COMPARE:
            a, b = args
            dtype = common_type(a.dtype, b.dtype, a.label, b.label)
            x, y = a.cast(dtype), b.cast(dtype)
            col = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[expr.op]
            return Val(col, T.BooleanType(), level, label, size)
        assert expr.op in ARITHMETIC
        args = [numeric(a, expr.op) for a in args]
        if len(args) == 1:
            return Val(-args[0].col, args[0].dtype, level, label, size)
        a, b = args
        if expr.op in ("/", "**"):
            x, y = a.cast(T.DoubleType()), b.cast(T.DoubleType())
            return Val(divide(x, y) if expr.op == "/" else F.pow(x, y), T.DoubleType(), level, label, size)
        dtype = common_type(a.dtype, b.dtype, a.label, b.label)
        x, y = a.cast(dtype), b.cast(dtype)
        whole = kind(dtype) == "integer"
        col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "//": lambda: floor_divide(x, y, whole), "%": lambda: modulo(x, y, whole)}[expr.op]()
        return Val(col.cast(dtype), dtype, level, label, size)


def sizes(args: list[Val]) -> str:
    return "many" if any(a.size == "many" for a in args) else "n" if any(a.size == "n" for a in args) else "one"


def numeric(v: Val, what: str) -> Val:
    """Numbers as they are, logicals as integers, anything else is an error."""
    k = kind(v.dtype)
    if k == "logical":
        return replace(v, col=v.col.cast(T.LongType()), dtype=T.LongType())
    if k == "unspecified":
        return replace(v, col=v.col.cast(T.DoubleType()), dtype=T.DoubleType())
    if isinstance(v.dtype, T.DecimalType):
        return replace(v, col=v.col.cast(T.DoubleType()), dtype=T.DoubleType())
    if k not in ("integer", "double"):
        raise ExprError(f"`{what}` needs numbers, but `{v.label}` is <{k}>.")
    return v


def divide(x: Column, y: Column) -> Column:
    """True division with R's results for zero: an infinity with the sign of x, or NaN."""
    nothing = F.when(x.isNull() | y.isNull(), null_of(T.DoubleType()))
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    by_zero = F.when(F.isnan(x), F.lit(float("nan"))).otherwise(by_zero)
    return nothing.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def floor_divide(x: Column, y: Column, whole: bool) -> Column:
    if not whole:
        q = divide(x, y)
        return F.when(F.isnan(q) | (F.abs(q) >= 2.0**53), q).otherwise(F.floor(q).cast("double"))
    r = F.try_mod(x, y)
    # x - r is a multiple of y, so the quotient is exact
    q = F.try_divide((x - r).cast("decimal(20,0)"), y.cast("decimal(20,0)")).cast("bigint")
    return q - F.when((r != 0) & ((r < 0) != (y < 0)), 1).otherwise(0)


def modulo(x: Column, y: Column, whole: bool) -> Column:
    """The remainder has the divisor's sign; by zero: NA for integers, NaN for doubles."""
    r = F.try_mod(x, y)
    r = F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)
    return r if whole else F.when((y == 0) & x.isNotNull(), F.lit(float("nan"))).otherwise(r)
