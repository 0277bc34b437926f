"""Groups as metadata."""

from __future__ import annotations

from typing import Any

from ..errors import VerbError
from ..table import Table, group_keys_of, verb
from .rows import computed, names_of


@verb
def group_by(data: Table, *cols: Any, _add: bool = False, **exprs: Any) -> Table:
    """Set the grouping columns (or add to them); named expressions are computed first, ungrouped."""
    t, names = computed(data, cols, exprs, "group_by")
    groups = data.groups + [n for n in names if n not in data.groups] if _add else names
    return Table(t.df, t.order, groups)


@verb
def ungroup(data: Table, *sel: Any) -> Table:
    """Drop all groups, or the selected ones."""
    if not sel:
        return data.ungroup()
    gone = names_of(list(sel), data, "ungroup", "cols")
    if odd := [n for n in gone if n not in data.groups]:
        raise VerbError("ungroup", f"`{odd[0]}` is no grouping column.")
    return Table(data.df, data.order, [g for g in data.groups if g not in gone])


@verb
def group_vars(data: Table) -> list[str]:
    return list(data.groups)


@verb
def n_groups(data: Table) -> int:
    """Number of groups; 1 without grouping columns.  Runs a job."""
    return data.n_groups()


@verb
def group_keys(data: Table) -> Table:
    """One row per group, sorted, missing keys last."""
    return group_keys_of(data)
