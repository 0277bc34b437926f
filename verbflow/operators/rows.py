"""Verbs on one table that keep, change, order or pick rows and columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprError, VerbError, inform
from ..expr import Col, Descending, Expr, wrap
from ..functions.conditional import Across
from ..plans.mask import LITERAL, ROW, WINDOW, Mask, Val, nan_to_null
from ..table import Table, c, hidden, verb
from ..tidyselect import everything, resolve, select_names
from ..types import kind


def names_of(sel: Any, t: Table, verb_name: str, argument: str) -> list[str]:
    parts = sel if isinstance(sel, (list, tuple)) else [sel]
    try:
        return list(dict.fromkeys(n for s in parts for n in resolve(s, t.schema)))
    except ExprError as e:
        raise VerbError(verb_name, str(e), argument) from e


def grouping(t: Table, by: Any, verb_name: str) -> tuple[list[str], bool]:
    """Groups in effect, and whether they come from ``_by``."""
    if by is None:
        return t.groups, False
    if t.groups:
        raise VerbError(verb_name, "`_by` can't be used on a grouped table; ungroup() it first.", "_by")
    return names_of(by, t, verb_name, "_by"), True


def stream_guard(t: Table, expr: Val, verb_name: str) -> None:
    if t.df.isStreaming and expr.level >= WINDOW:
        raise VerbError(verb_name, "On a stream only row-wise expressions can be used.")


def compiled(mask: Mask, expr: Any, verb_name: str, argument: str) -> Val:
    try:
        v = mask.compile(expr)
    except ExprError as e:
        raise VerbError(verb_name, str(e), argument) from e
    if v.size == "many":
        raise VerbError(verb_name, "The result must have the size of the group or size 1; use reframe().", argument)
    stream_guard(mask.table, v, verb_name)
    return v


def restore(t: Table, mask: Mask, extra: list[str] = ()) -> Table:
    """The mask's table without the hidden columns it made on the way."""
    gone = [n for n in mask.made if n not in {o for o, _ in mask.table.order or []} and n not in extra]
    return mask.table.but(mask.df.drop(*gone), groups=t.groups)


@verb
def filter(data: Table, *conditions: Any, _by: Any = None, **named: Any) -> Table:  # noqa: A001
    """Rows for which all conditions are true; a missing condition drops the row.

    Row-wise conditions become one plain filter that reaches the scan; only those with
    summaries or windows are computed as hidden columns first.
    """
    if named:
        name = next(iter(named))
        raise VerbError("filter", f"Conditions have no names; write `f.{name} == ...` instead of `{name}=...`.", name)
    groups, _ = grouping(data, _by, "filter")
    mask = Mask(data, groups)
    plain, late = [], []
    for i, q in enumerate(conditions, 1):
        before = len(mask.made)
        v = compiled(mask, q, "filter", f"{i}")
        if kind(v.dtype) not in ("logical", "unspecified"):
            raise VerbError("filter", f"A condition must be logical, but `{wrap(q)!r}` is <{kind(v.dtype)}>.", f"{i}")
        col = v.cast(T.BooleanType())
        if v.level >= WINDOW:
            late.append(mask.add(col))
        elif len(mask.made) > before:
            late.append(col)
        else:
            plain.append(col)
    out = mask.df
    if not late:
        for col in plain:
            out = out.filter(col)
    else:  # summaries see all rows, so every condition applies after them
        for col in [*plain, *late]:
            out = out.filter(col)
    mask.table = mask.table.but(out)
    return restore(data, mask)


def ordered_items(verb_name: str, positional: tuple, named: dict[str, Any]) -> list:
    for i, a in enumerate(positional, 1):
        if not isinstance(a, Across):
            raise VerbError(verb_name, "Expressions need a name (name=...); only across() goes without.", f"{i}")
    return [*positional, *named.items()]


@verb
def mutate(data: Table, *across: Any, _keep: str = "all", _before: Any = None, _after: Any = None, _by: Any = None, **new: Any) -> Table:
    """Create, change or (with None) delete columns; every expression sees the ones before it.

    Neighbouring row-wise results share one projection.
    """
    if _keep not in ("all", "used", "unused", "none"):
        raise VerbError("mutate", f'`_keep` must be "all", "used", "unused" or "none", not {_keep!r}.', "_keep")
    groups, _ = grouping(data, _by, "mutate")
    original = data.columns
    used: set[str] = set()
    touched: list[str] = []
    mask = Mask(data, groups)

    def one(name: str, value: Any) -> None:
        if name in groups:
            raise VerbError("mutate", f"`{name}` is a grouping column and can't be changed.", name)
        if value is None:
            if name in mask.df.columns:
                mask.table = mask.table.but(mask.df.drop(name))
            if name in touched:
                touched.remove(name)
            return
        expr = wrap(value)
        used.update(n for n in reads(expr, mask) if n in original and n not in touched)
        v = compiled(mask, expr, "mutate", name)
        mask.table = mask.table.but(mask.df.withColumn(name, v.col))
        if name not in touched:
            touched.append(name)

    for item in ordered_items("mutate", across, new):
        if isinstance(item, Across):
            try:
                pairs = item.expand(mask.table.schema, groups)
            except ExprError as e:
                raise VerbError("mutate", str(e), "across") from e
            for name, value in pairs:
                one(name, value)
        else:
            one(*item)

    t = restore(data, mask)
    have = t.columns
    keys = groups
    if _keep == "all":
        keep = have
    elif _keep == "used":
        keep = [n for n in have if n in used or n in touched or n in keys]
    elif _keep == "unused":
        keep = [n for n in have if n not in used or n in touched or n in keys]
    else:
        keep = [n for n in have if n in touched or n in keys]
    fresh = [n for n in touched if n not in original]
    if _keep == "none":
        keep = [n for n in keep if n not in touched] + [n for n in touched if n in keep]
    if _before is not None or _after is not None:
        keep = moved(t, keep, fresh, _before, _after, "mutate")
    return t.pick({n: n for n in keep}) if keep != have else t


def reads(expr: Expr, mask: Mask) -> set[str]:
    """Columns an expression reads, those of if_any(), if_all() and pick() included."""
    out = set(expr.names())
    stack = [expr]
    while stack:
        e = stack.pop()
        stack += e.children
        sel = getattr(e, "selection", None)
        if sel is not None:
            for s in sel if isinstance(sel, list) else [sel]:
                try:
                    out |= set(resolve(s, mask.table.schema)) - set(mask.groups)
                except ExprError:
                    pass
    return out


def moved(t: Table, names: list[str], moving: list[str], before: Any, after: Any, verb_name: str) -> list[str]:
    """``names`` with ``moving`` beside the anchor; anchors that move themselves don't count."""
    if before is not None and after is not None:
        raise VerbError(verb_name, "Give `_before` or `_after`, not both.")
    rest = [n for n in names if n not in moving]
    at = 0
    if before is not None or after is not None:
        anchor = [n for n in names_of(before if before is not None else after, t, verb_name, "_before" if before is not None else "_after") if n in rest]
        if anchor:
            places = sorted(rest.index(n) for n in anchor)
            at = places[0] if before is not None else places[-1] + 1
        elif after is not None:
            at = len(rest)
    return rest[:at] + moving + rest[at:]


def chosen(t: Table, verb_name: str, sel: tuple, renames: dict, several: bool = True) -> dict[str, str]:
    try:
        return select_names(t.schema, sel, renames, several)
    except ExprError as e:
        raise VerbError(verb_name, str(e)) from e


@verb
def select(data: Table, *sel: Any, **renames: Any) -> Table:
    """Columns by the selection language, renamed by ``new=old``; grouping columns stay."""
    picked = chosen(data, "select", sel, renames)
    lost = [g for g in data.groups if g not in picked]
    if lost:
        inform(f"Adding missing grouping columns: {', '.join(f'`{g}`' for g in lost)}.")
        picked = {**{g: g for g in lost}, **picked}
    return data.pick(picked)


@verb
def rename(data: Table, *positional: Any, **renames: Any) -> Table:
    """``new=old``; columns keep their places."""
    if positional:
        raise VerbError("rename", "Columns are renamed by name: new=old.")
    found = chosen(data, "rename", (), renames, several=False)
    return _renamed(data, found, "rename")


def _renamed(data: Table, found: dict[str, str], verb_name: str) -> Table:
    names = {n: found.get(n, n) for n in data.columns}
    twice = sorted({n for n in names.values() if list(names.values()).count(n) > 1})
    if twice:
        raise VerbError(verb_name, f"Names must be unique; `{twice[0]}` would occur twice.")
    return data.pick(names)


@verb
def rename_with(data: Table, fn: Callable[[str], str], cols: Any = None) -> Table:
    """Rename by a function of the name."""
    return _renamed(data, {n: fn(n) for n in names_of(everything() if cols is None else cols, data, "rename_with", "cols")}, "rename_with")


@verb
def relocate(data: Table, *sel: Any, _before: Any = None, _after: Any = None, **renames: Any) -> Table:
    """Move (and rename) columns, to the front unless an anchor is given."""
    found = chosen(data, "relocate", sel, renames)
    order = moved(data, data.columns, list(found), _before, _after, "relocate")
    return _renamed(data.pick({n: n for n in order}), found, "relocate")


def sort_keys(mask: Mask, keys: tuple, verb_name: str) -> list[tuple[Val, bool]]:
    out = []
    for i, k in enumerate(keys, 1):
        node = wrap(k)
        down = isinstance(node, Descending)
        v = compiled(mask, node.children[0] if down else node, verb_name, f"{i}")
        if isinstance(v.dtype, (T.ArrayType, T.MapType)):
            raise VerbError(verb_name, f"Lists can't be sorted by: `{node!r}`.", f"{i}")
        out.append((v, not down))
    return out


@verb
def arrange(data: Table, *keys: Any, _by_group: bool = False, **named: Any) -> Table:
    """Order rows, stably; missing values come last in either direction.

    No sort runs here: the keys become part of the table's row order.
    """
    if named:
        raise VerbError("arrange", f"Sort keys have no names: `{next(iter(named))}`.")
    if not keys and not (_by_group and data.groups):
        return data
    mask = Mask(data.with_order(), [])
    order: list[tuple[str, bool]] = []
    columns = []
    if _by_group:
        for g in data.groups:
            name = hidden()
            order.append((name, True))
            columns.append(c(g).alias(name))
    for v, up in sort_keys(mask, keys, "arrange"):
        v = mask.flat(v) if v.level > ROW else v
        if v.level == LITERAL:
            continue
        name = hidden()
        order.append((name, up))
        columns.append(nan_to_null(v).alias(name))
    t = mask.table
    t = t.but(t.df.select("*", *columns), groups=data.groups)
    gone = [n for n in mask.made if n not in {o for o, _ in order}]
    return Table(t.df.drop(*gone), order + (t.order or []), data.groups)


@verb
def pull(data: Table, var: Any = None) -> list:
    """One column as a list in row order; by default the last."""
    names = [data.columns[-1]] if var is None else names_of(var, data, "pull", "var")
    if len(names) != 1:
        raise VerbError("pull", f"`var` must select one column, not {len(names)}.", "var")
    return data.ungroup()[names[0]]


@verb
def distinct(data: Table, *cols: Any, _keep_all: bool = False, **exprs: Any) -> Table:
    """The first row of each combination; missing equals missing.  Without columns: of all columns."""
    data, names = computed(data, cols, exprs, "distinct")
    keys = data.groups + [n for n in names if n not in data.groups]
    keys = keys if names else data.columns
    t = data.with_order()
    if (not _keep_all or set(keys) == set(data.columns)) and all(up for _, up in t.order):
        # an aggregate with partial sums rather than a window: a frequent combination does no harm
        at = hidden()
        df = t.df.groupBy(*map(c, keys)).agg(F.min(F.struct(*(c(n) for n, _ in t.order))).alias(at))
        return Table(df, [(at, True)], data.groups)
    mask = Mask(t, keys)
    first = mask.add(F.row_number().over(mask.ordered()))
    t = mask.table.but(mask.df.filter(first == 1).drop(*mask.made))
    return t if _keep_all or not names else t.pick({n: n for n in keys})


def computed(data: Table, cols: tuple, exprs: dict[str, Any], verb_name: str) -> tuple[Table, list[str]]:
    """Columns to group or count by: selected ones, and named expressions computed ungrouped first."""
    names: list[str] = []
    for i, x in enumerate(cols, 1):
        node = wrap(x)
        try:
            names += [n for n in resolve(node, data.schema) if n not in names]
        except ExprError as e:
            hint = "" if isinstance(node, Col) or isinstance(x, str) else " Expressions need a name."
            raise VerbError(verb_name, str(e) + hint, f"{i}") from e
    if exprs:
        groups = data.groups
        data = mutate(data.ungroup(), **exprs)
        data = data.but(groups=groups)
        names += [n for n in exprs if n not in names]
    return data, names
