"""A data-manipulation grammar compiled to lazy Spark plans.

    from verbflow import f, filter, group_by, mean, summarise
    df >> filter(f.x > 1) >> group_by(f.g) >> summarise(m=mean(f.x))

Names such as ``sum`` or ``filter`` shadow Python's; import what you need.
"""

from .errors import ExprError, VerbError, VerbMessage
from .expr import NA, Call, Expr, f
from .functions.conditional import across, between, case_match, case_when, coalesce, if_all, if_any, if_else, is_in, is_na, na_if, near, pick
from .functions.math import abs, as_character, as_double, as_integer, as_logical, ceiling, exp, floor, log, log2, log10, pmax, pmin, round, sqrt
from .functions.summary import IQR, all, any, first, last, mad, max, mean, median, min, n, n_distinct, nth, quantile, sd, sum, var
from .functions.window import consecutive_id, cumall, cumany, cume_dist, cummax, cummean, cummin, cumsum, dense_rank, desc, lag, lead, min_rank, ntile, percent_rank, row_number
from .operators.bind import bind_cols, bind_rows
from .operators.groups import group_by, group_keys, group_vars, n_groups, ungroup
from .operators.joins import anti_join, closest, cross_join, full_join, inner_join, join_by, left_join, nest_join, overlaps, right_join, semi_join, within
from .operators.rows import arrange, distinct, filter, mutate, pull, relocate, rename, rename_with, select
from .operators.sets import intersect, setdiff, symdiff, union, union_all
from .operators.slices import slice_head, slice_max, slice_min, slice_sample, slice_tail
from .operators.summarise import add_count, count, reframe, summarise, summarize, tally
from .sources import read_parquet, write_parquet
from .table import Table, table
from .tidyselect import all_of, any_of, contains, ends_with, everything, last_col, matches, num_range, starts_with, where
from .types import is_character, is_double, is_integer, is_logical, is_numeric

__version__ = "0.1.0"
__all__ = [name for name in dir() if not name.startswith("_") and name not in ("errors", "expr", "functions", "operators", "plans", "sources", "streaming", "table_", "tidyselect", "types")]
