"""Verbs that aggregate: one pass of groupBy().agg() per call."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError, VerbError, inform
from ..expr import Expr, wrap
from ..functions.conditional import Across
from ..functions.summary import n as rows_in_group
from ..functions.summary import sum as sum_of
from ..plans.mask import Mask, Val, fail
from ..table import Table, c, hidden, sorted_by, verb
from .rows import computed, grouping, ordered_items


def aggregated(mask: Mask, columns: list[Column]):
    keys = [c(g) for g in mask.groups]
    return mask.df.groupBy(*keys).agg(*columns) if keys else mask.df.agg(*columns)


def summary_items(data: Table, groups: list[str], items: list, verb_name: str):
    """(name, expression) in order, ``across`` expanded where it stands over the table's own columns."""
    for item in items:
        if isinstance(item, Across):
            try:
                yield from item.expand(data.schema, groups)
            except ExprError as e:
                raise VerbError(verb_name, str(e), "across") from e
        else:
            yield item


@verb
def summarise(data: Table, *across: Any, _by: Any = None, _groups: str | None = None, **named: Any) -> Table:
    """One row per group, sorted by key (missing last).

    Later results see earlier ones as the group's scalars: they are put in place in the
    expression, so all results come from a single aggregation.
    """
    if _groups not in (None, "drop_last", "drop", "keep"):
        raise VerbError("summarise", f'`_groups` must be "drop_last", "drop" or "keep", not {_groups!r}.', "_groups")
    groups, from_by = grouping(data, _by, "summarise")
    if from_by and _groups is not None:
        raise VerbError("summarise", "`_groups` can't be used with `_by`.", "_groups")
    mask = Mask(data, groups, mode="agg")
    results: dict[str, Val] = {}
    for name, value in summary_items(data, groups, ordered_items("summarise", across, named), "summarise"):
        if name in groups:
            raise VerbError("summarise", f"`{name}` is a grouping column and can't be changed.", name)
        if value is None:
            results.pop(name, None)
            mask.earlier.pop(name, None)
            continue
        expr = wrap(value)
        try:
            results[name] = mask.summary_item(expr)
        except ExprError as e:
            raise VerbError("summarise", str(e), name) from e
        mask.earlier = {**mask.earlier, name: (expr, mask.earlier)}
    columns = [v.col.alias(name) for name, v in results.items()] or [F.count(F.lit(1)).alias(hidden())]
    df = aggregated(mask, columns)
    if not results:
        df = df.select(*map(c, groups))
    if _groups is None and not from_by and len(groups) > 1:
        inform(f"The result is grouped by {', '.join(groups[:-1])}; choose with `_groups`.")
    left = [] if from_by or _groups == "drop" else groups if _groups == "keep" else groups[:-1]
    return sorted_by(df, groups, left) if groups else Table(df)


summarize = summarise


@verb
def reframe(data: Table, *across: Any, _by: Any = None, **named: Any) -> Table:
    """Any number of rows per group; sizes in a group must agree or be 1.  The result is ungrouped."""
    groups, _ = grouping(data, _by, "reframe")
    mask = Mask(data, groups, mode="agg")
    parts: list[tuple[str, Val, bool]] = []
    for name, value in summary_items(data, groups, ordered_items("reframe", across, named), "reframe"):
        if name in groups:
            raise VerbError("reframe", f"`{name}` is a grouping column and can't be changed.", name)
        if value is None:
            parts = [p for p in parts if p[0] != name]
            continue
        expr = wrap(value)
        done = {p[0] for p in parts} - set(data.columns)
        if expr.names() & done:
            raise VerbError("reframe", f"`{sorted(expr.names() & done)[0]}` is a result of this call and can't be used in it.", name)
        try:
            v, many = rows_of(mask, expr)
        except ExprError as e:
            raise VerbError("reframe", str(e), name) from e
        parts = [p for p in parts if p[0] != name] + [(name, v, many)]
    if not parts:
        return Table(sorted_by(mask.df.select(*map(c, groups)).distinct(), groups).df) if groups else Table(data.df.limit(0).select())
    inner = [hidden() for _ in parts]
    df = aggregated(mask, [v.col.alias(h) for (_, v, _), h in zip(parts, inner, strict=True)])
    lists = [h for (_, _, many), h in zip(parts, inner, strict=True) if many]
    at = hidden()
    if not lists:
        df = df.select(*map(c, groups), *(c(h).alias(name) for (name, _, _), h in zip(parts, inner, strict=True)))
        return sorted_by(df, groups).ungroup() if groups else Table(df)
    sizes = [F.size(c(h)) for h in lists]
    size = sizes[0]
    for s in sizes[1:]:
        size = F.when(size == s, size).when(size == 1, s).when(s == 1, size).otherwise(fail("The results of a group must have the same size, or size 1.", T.IntegerType()))
    count = hidden()
    df = df.withColumn(count, size).filter(c(count) > 0)
    df = df.withColumn(at, F.explode(F.sequence(F.lit(1), c(count))))

    def value(h: str, many: bool) -> Column:
        return F.when(F.size(c(h)) == 1, F.try_element_at(c(h), F.lit(1))).otherwise(F.try_element_at(c(h), c(at))) if many else c(h)

    df = df.select(*map(c, groups), *(value(h, many).alias(name) for (name, _, many), h in zip(parts, inner, strict=True)), c(at))
    t = sorted_by(df, groups)
    return Table(t.df, [*(t.order or []), (at, True)], [])


def rows_of(mask: Mask, expr: Expr) -> tuple[Val, bool]:
    """A group's values: a scalar summary, or an array in row order."""
    if mask.is_summary(expr):
        v = mask.compile(expr)
        return v, v.size == "many"
    from ..expr import Call

    if isinstance(expr, Call) and expr.kind == "multi":
        return mask.compile(expr), True
    from ..expr import Values

    if isinstance(expr, Values):
        from ..plans.mask import AGGREGATE, literal_type
        from ..types import common_of

        dtype = common_of([literal_type(x) for x in expr.values] or [T.NullType()], ["x"] * max(1, len(expr.values)))
        return Val(F.array(*(F.lit(x).cast(dtype) for x in expr.values)), dtype, AGGREGATE, repr(expr), "many"), True
    v = mask.rows(lambda: mask.flat(mask.compile(expr)))
    at = mask.rows(mask.position)
    items = F.array_sort(F.collect_list(F.struct(at.alias("o"), v.col.alias("v"))))
    return Val(F.transform(items, lambda x: x["v"]), v.dtype, v.level, v.label, "many"), True


def count_name(taken: list[str], name: str | None) -> str:
    if name is not None:
        return name
    out = "n"
    while out in taken:
        out += "n"
    if out != "n":
        inform(f"The count is named `{out}`, because `n` is taken; choose with `name`.")
    return out


def weight(wt: Any) -> Expr:
    return rows_in_group() if wt is None else sum_of(wt, na_rm=True)


def counted(data: Table, keys: list[str], wt: Any, sort: bool, name: str | None, verb_name: str) -> Table:
    label = count_name(keys, name)
    if label in keys:
        raise VerbError(verb_name, f"`{label}` is one of the columns that are counted by.", "name")
    mask = Mask(data.ungroup(), keys, mode="agg")
    try:
        v = mask.summary_item(weight(wt))
    except ExprError as e:
        raise VerbError(verb_name, str(e), "wt") from e
    t = sorted_by(aggregated(mask, [v.col.alias(label)]), keys) if keys else Table(aggregated(mask, [v.col.alias(label)]))
    if sort:
        h = hidden()
        t = Table(t.df.withColumn(h, c(label)), [(h, False), *(t.order or [])])
    return t


@verb
def count(data: Table, *cols: Any, wt: Any = None, sort: bool = False, name: str | None = None, **exprs: Any) -> Table:
    """Rows (or the sum of ``wt``) by groups and columns; the input's groups stay."""
    t, names = computed(data, cols, exprs, "count")
    keys = data.groups + [n for n in names if n not in data.groups]
    return counted(t, keys, wt, sort, name, "count").but(groups=data.groups)


@verb
def tally(data: Table, wt: Any = None, sort: bool = False, name: str | None = None) -> Table:
    """Rows by the current groups; the last grouping column is dropped."""
    return counted(data, data.groups, wt, sort, name, "tally").but(groups=data.groups[:-1])


@verb
def add_count(data: Table, *cols: Any, wt: Any = None, sort: bool = False, name: str | None = None, **exprs: Any) -> Table:
    """The count as a new column; rows and groups stay."""
    t, names = computed(data, cols, exprs, "add_count")
    keys = data.groups + [n for n in names if n not in data.groups]
    label = count_name(t.columns, name)
    mask = Mask(t.ungroup() if not sort else t.ungroup().with_order(), keys)
    try:
        v = mask.compile(weight(wt))
    except ExprError as e:
        raise VerbError("add_count", str(e), "wt") from e
    df = mask.df.withColumn(label, v.col)
    gone = [n for n in mask.made if n not in {o for o, _ in mask.table.order or []}]
    out = Table(df.drop(*gone), mask.table.order, data.groups)
    if sort:
        h = hidden()
        out = Table(out.df.withColumn(h, c(label)), [(h, False), *(out.order or [])], data.groups)
    return out
