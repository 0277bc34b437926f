"""Row and column binding."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError, VerbError, inform
from ..plans.mask import literal, literal_type
from ..table import Table, c, frame, hidden, is_frame, table
from ..types import common_of


def _flat(items: tuple) -> list[tuple[str, Any]]:
    out: list[tuple[str, Any]] = []
    for x in items:
        if isinstance(x, dict):
            out += [(str(k), v) for k, v in x.items()]
        elif isinstance(x, (list, tuple)) and all(is_frame(v) for v in x):
            out += [("", v) for v in x]
        else:
            out.append(("", x))
    return [(k or str(i), v) for i, (k, v) in enumerate(out, 1)]


def bind_rows(*frames: Any, _id: str | None = None) -> Table:
    """Rows of all tables by column name; what a table lacks is missing.  ``_id`` names a column that tells the tables apart."""
    items = [(k, frame(v, "bind_rows", f"{i}")) for i, (k, v) in enumerate(_flat(frames), 1) if v is not None]
    if not items:
        from pyspark.sql import SparkSession

        return Table(SparkSession.getActiveSession().range(0).select())
    names = list(dict.fromkeys(n for _, t in items for n in t.columns))
    if _id is not None and _id in names:
        raise VerbError("bind_rows", f"A table has a column `{_id}` already.", "_id")
    types: dict[str, T.DataType] = {}
    for n in names:
        have = [(f"..{i}${n}", t.schema[n].dataType) for i, (_, t) in enumerate(items, 1) if n in t.columns]
        try:
            types[n] = common_of([d for _, d in have], [w for w, _ in have])
        except ExprError as e:
            raise VerbError("bind_rows", str(e)) from e
    which = hidden()
    parts: list[DataFrame] = []
    order = [(which, True)]
    for i, (key, t) in enumerate(items):
        t = t.with_order()
        columns = [F.lit(key).alias(_id)] if _id is not None else []
        columns += [(c(n).cast(types[n]) if n in t.columns else F.lit(None).cast(types[n])).alias(n) for n in names]
        # every table keeps its own order keys; in the others' rows they are missing
        own = [(hidden(), n, up) for n, up in t.order]
        parts.append(t.df.select(*columns, F.lit(i).alias(which), *(c(n).alias(h) for h, n, _ in own)))
        order += [(h, up) for h, _, up in own]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return Table(out, order, items[0][1].groups)


def bind_cols(*frames: Any) -> Table:
    """Tables (and lists of values) side by side, row by row; one row is repeated."""
    parts: list[Table] = []
    flat = [v for x in frames for v in (x if isinstance(x, (list, tuple)) and x and all(is_frame(y) for y in x) else [x])]
    spark = next((table(v).df.sparkSession for v in flat if is_frame(v)), None)
    if spark is None:
        raise VerbError("bind_cols", "At least one argument must be a table.")
    for i, v in enumerate(flat, 1):
        if is_frame(v):
            parts.append(frame(v, "bind_cols", f"{i}").with_order())
        elif isinstance(v, (list, tuple)):
            try:
                dtype = common_of([literal_type(x) for x in v] or [T.NullType()], ["x"] * max(1, len(v)))
            except ExprError as e:
                raise VerbError("bind_cols", str(e), f"{i}") from e
            h = hidden()
            values = F.array(*(literal(x).cast(dtype) for x in v)).cast(T.ArrayType(dtype))
            df = spark.range(1).select(F.posexplode(values).alias(h, f"...{i}"))
            parts.append(Table(df, [(h, True)]))
        else:
            raise VerbError("bind_cols", f"`{type(v).__name__}` can't be bound.", f"{i}")
    names = [n for t in parts for n in t.columns]
    fixed = [f"{n}...{i}" if names.count(n) > 1 else n for i, n in enumerate(names, 1)]
    if fixed != names:
        inform(f"New names: {', '.join(f'`{a}` -> `{b}`' for a, b in zip(names, fixed, strict=True) if a != b)}.")
    if len(parts) == 1:
        return parts[0].ungroup()
    row = hidden()
    frames_: list[DataFrame] = []
    at = 0
    for t in parts:
        mine = fixed[at : at + t.width]
        at += t.width
        columns = [c(n).alias(f) for n, f in zip(t.columns, mine, strict=True)]
        numbered = t.df.select(*columns, F.row_number().over(Window.orderBy(*t.order_columns())).alias(row))
        frames_.append(numbered)
    # sizes are needed before rows can be repeated; one count per table, all in one job
    counts = frames_[0].agg(F.count(F.lit(1)).alias("n0"))
    for i, d in enumerate(frames_[1:], 1):
        counts = counts.crossJoin(d.agg(F.count(F.lit(1)).alias(f"n{i}")))
    n = counts.first()
    most = max(n)
    if 0 in n and most == 1:
        most = 0
    if odd := [k for k in n if k not in (1, most)]:
        raise VerbError("bind_cols", f"Tables must have {most} rows or 1, not {odd[0]}.")
    out = None
    for d, k in zip(frames_, n, strict=True):
        if k != most:  # one row: repeated, whatever the other's position
            single = d.drop(row)
            out = single if out is None else out.crossJoin(F.broadcast(single))
        else:
            out = d if out is None else (out.join(d, row) if row in out.columns else d.crossJoin(F.broadcast(out)))
    order = [(row, True)] if row in out.columns else None
    return Table(out.select(*(c(x) for x in fixed), *([c(row)] if order else [])), order)
