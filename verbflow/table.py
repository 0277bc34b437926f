"""Table: a Spark DataFrame with row order and groups as metadata, and the ``>>`` pipe."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import VerbError

HIDDEN = "__vf_"
_serial = itertools.count()


def hidden() -> str:
    return f"{HIDDEN}{next(_serial)}"


def c(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def spark_case(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    return df


class Table:
    """``order``: hidden columns with direction that give the row order; None until someone needs it."""

    def __init__(self, df: DataFrame, order: list[tuple[str, bool]] | None = None, groups: Sequence[str] = ()):
        self.df, self.order, self.groups = df, order, list(groups)

    # what users see
    @property
    def columns(self) -> list[str]:
        return [n for n in self.df.columns if not n.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([x for x in self.df.schema.fields if not x.name.startswith(HIDDEN)])

    @property
    def data(self) -> Table:
        return Table(self.df, self.order)

    @property
    def height(self) -> int:
        return self.df.count()

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def __len__(self) -> int:
        return self.height

    def __getitem__(self, name: str) -> list:
        return [r[0] for r in self.to_spark(ordered=True).select(c(name)).collect()]

    def group_keys(self) -> Table:
        return group_keys_of(self)

    def n_groups(self) -> int:
        return self.df.select(*map(c, self.groups)).distinct().count() if self.groups else 1

    def ungroup(self) -> Table:
        return Table(self.df, self.order)

    def to_spark(self, ordered: bool = False) -> DataFrame:
        """The plain DataFrame; with ``ordered`` in row order, which costs a sort."""
        df = self.df
        if ordered and self.order:
            df = df.orderBy(*self.order_columns())
        return df.select(*map(c, self.columns))

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.to_spark(ordered=True).collect()]

    def collect(self):
        return self.to_spark(ordered=True).collect()

    def to_pandas(self):
        return self.to_spark(ordered=True).toPandas()

    def __repr__(self) -> str:
        grouped = f", grouped by {', '.join(self.groups)}" if self.groups else ""
        return f"<Table {', '.join(f'{x.name}: {x.dataType.simpleString()}' for x in self.schema.fields)}{grouped}>"

    # what verbs use
    def order_columns(self) -> list[Column]:
        return [c(n).asc_nulls_last() if up else c(n).desc_nulls_last() for n, up in self.order or []]

    def with_order(self) -> Table:
        """This table with a row order: the position in its files where it has any, else in its partitions."""
        if self.order is not None:
            return self
        if self.df.isStreaming:
            raise VerbError("table", "A stream has no row order; use verbs that do not depend on it.")
        a, b = hidden(), hidden()
        if "_metadata" not in self.df.columns and _from_files(self.df):
            df = self.df.select("*", F.col("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
            return Table(df, [(a, True), (b, True)], self.groups)
        return Table(self.df.withColumn(a, F.monotonically_increasing_id()), [(a, True)], self.groups)

    def but(self, df: DataFrame | None = None, groups: Sequence[str] | None = None, order: Any = "same") -> Table:
        df = self.df if df is None else df
        groups = self.groups if groups is None else groups
        return Table(df, self.order if order == "same" else order, [g for g in groups if g in df.columns])

    def pick(self, names: dict[str, str]) -> Table:
        """Columns old -> new in this order; hidden order columns stay, groups follow their new names."""
        keep = [n for n, _ in self.order or []]
        df = self.df.select(*(c(o).alias(n) for o, n in names.items()), *map(c, keep))
        return Table(df, self.order, [names[g] for g in self.groups if g in names])


def group_keys_of(t: Table) -> Table:
    """One row per group, sorted, missing keys last; one row without columns if there are no groups."""
    if not t.groups:
        return Table(t.df.sparkSession.range(1).select())
    return sorted_by(t.df.select(*map(c, t.groups)).distinct(), t.groups)


def _from_files(df: DataFrame) -> bool:
    """Whether the rows still know their place in their files."""
    try:
        return "_metadata" in df._jdf.queryExecution().analyzed().metadataOutput().mkString(",")
    except AttributeError:  # no JVM at hand (Spark Connect)
        return False


def sorted_by(df: DataFrame, keys: Sequence[str], groups: Sequence[str] = ()) -> Table:
    """A result whose rows come by its keys, missing ones last (NaN before NULL)."""
    names = [hidden() for _ in keys]
    return Table(df.select("*", *(c(k).alias(n) for k, n in zip(keys, names, strict=True))), [(n, True) for n in names], groups)


def table(data: DataFrame | Table, order_by: Sequence[str] | None = None) -> Table:
    """Wrap a DataFrame; ``order_by`` names columns that fix the row order from the start."""
    if isinstance(data, Table):
        return data
    t = Table(data)
    return sorted_by(data, order_by) if order_by else t


class Pipeable:
    def __init__(self, fn: Callable, args: tuple, kwargs: dict):
        self.fn, self.args, self.kwargs = fn, args, kwargs

    def __rrshift__(self, data: Any) -> Any:
        return self.fn(data, *self.args, **self.kwargs)

    def __repr__(self) -> str:
        return f"<{self.fn.__name__}() waiting for data: use df >> ...>"


def is_frame(x: Any) -> bool:
    return isinstance(x, (Table, DataFrame))


def frame(x: Any, verb: str, argument: str = "data") -> Table:
    if not is_frame(x):
        kind = type(x)
        hint = " Convert it with spark.createDataFrame(df)." if kind.__module__.startswith(("pandas", "pyarrow", "polars")) else ""
        raise VerbError(verb, f"`{argument}` must be a Spark DataFrame or a Table, not `{kind.__name__}`.{hint}")
    t = table(x)
    clash = [n for n in t.df.columns if n.startswith(HIDDEN)] if isinstance(x, DataFrame) else []
    if clash:
        raise VerbError(verb, f"Column names that start with `{HIDDEN}` are reserved: `{clash[0]}`.")
    spark_case(t.df)
    return t


def _foreign(x: Any) -> bool:
    return type(x).__name__ in ("DataFrame", "LazyFrame", "Series") and not is_frame(x)


def verb(fn: Callable) -> Callable:
    """``fn(data, ...)`` and ``data >> fn(...)`` both work."""

    @functools.wraps(fn)
    def call(*args, **kwargs):
        if args and (is_frame(args[0]) or _foreign(args[0])):
            return fn(frame(args[0], fn.__name__), *args[1:], **kwargs)
        return Pipeable(lambda data, *a, **k: fn(frame(data, fn.__name__), *a, **k), args, kwargs)

    return call


def two_tables(fn: Callable) -> Callable:
    """``fn(x, y, ...)`` and ``x >> fn(y, ...)``."""

    @functools.wraps(fn)
    def call(*args, **kwargs):
        if len(args) > 1 and is_frame(args[0]) and is_frame(args[1]):
            return fn(frame(args[0], fn.__name__, "x"), frame(args[1], fn.__name__, "y"), *args[2:], **kwargs)
        return Pipeable(lambda x, y, *a, **k: fn(frame(x, fn.__name__, "x"), frame(y, fn.__name__, "y"), *a, **k), args, kwargs)

    return call
