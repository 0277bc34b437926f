"""Set operations on rows: missing equals missing, rows in order of first appearance."""

from __future__ import annotations



from ..errors import ExprError, VerbError
from ..table import Table, c, two_tables
from ..types import common_type
from .bind import bind_rows
from .joins import JoinBy, On, _filtering
from .rows import distinct


def aligned(x: Table, y: Table, verb_name: str) -> tuple[Table, Table]:
    """Both with x's columns in x's order and common types."""
    more, less = [n for n in y.columns if n not in x.columns], [n for n in x.columns if n not in y.columns]
    if more or less:
        told = [f"only in {side}: {', '.join(f'`{n}`' for n in names)}" for side, names in (("x", less), ("y", more)) if names]
        raise VerbError(verb_name, f"x and y must have the same columns ({'; '.join(told)}).")
    both = []
    types = {}
    for n in x.columns:
        try:
            types[n] = common_type(x.schema[n].dataType, y.schema[n].dataType, f"x${n}", f"y${n}")
        except ExprError as e:
            raise VerbError(verb_name, str(e)) from e
    for t in (x, y):
        keep = [n for n, _ in t.order or []]
        both.append(Table(t.df.select(*(c(n).cast(types[n]).alias(n) for n in x.columns), *map(c, keep)), t.order, x.groups))
    return both[0], both[1]


def _first_rows(t: Table) -> Table:
    return distinct(t.ungroup()).but(groups=t.groups)


def _matching(x: Table, y: Table, how: str, verb_name: str) -> Table:
    by = JoinBy([On("==", n, n) for n in x.columns])
    return _filtering(verb_name, how, x, y.ungroup(), by, "na")


@two_tables
def union(x: Table, y: Table) -> Table:
    """Distinct rows of both."""
    a, b = aligned(x, y, "union")
    return _first_rows(bind_rows(a, b))


@two_tables
def union_all(x: Table, y: Table) -> Table:
    """All rows of x, then all of y."""
    a, b = aligned(x, y, "union_all")
    return bind_rows(a, b)


@two_tables
def intersect(x: Table, y: Table) -> Table:
    """Distinct rows of x that are in y."""
    a, b = aligned(x, y, "intersect")
    return _matching(_first_rows(a), b, "left_semi", "intersect")


@two_tables
def setdiff(x: Table, y: Table) -> Table:
    """Distinct rows of x that aren't in y."""
    a, b = aligned(x, y, "setdiff")
    return _matching(_first_rows(a), b, "left_anti", "setdiff")


@two_tables
def symdiff(x: Table, y: Table) -> Table:
    """Distinct rows of x that aren't in y, then those of y that aren't in x."""
    a, b = aligned(x, y, "symdiff")
    return bind_rows(_matching(_first_rows(a), b, "left_anti", "symdiff"), _matching(_first_rows(b), a, "left_anti", "symdiff"))
