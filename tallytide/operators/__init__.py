"""Operators from DataFrame to DataFrame; date and key columns are parameters."""

from tallytide.operators.calendar import (
    PERIODS,
    Calendar,
    as_of_date,
    reporting_calendar,
    resolve_calendar,
)
from tallytide.operators.combine import distinct_keys, sorted_by_keys, union_by_name
from tallytide.operators.counts import (
    COUNTS,
    combine_period_counts,
    monthly_counts,
    period_count,
    period_counts,
    rows_in_period,
    with_growth,
)
from tallytide.operators.membership import attach_members, keep_members
from tallytide.operators.ranking import ranked_page, report_order, top_n, with_rank
from tallytide.operators.tables import filter_columns, page, preview

__all__ = [
    "COUNTS",
    "PERIODS",
    "Calendar",
    "as_of_date",
    "attach_members",
    "combine_period_counts",
    "distinct_keys",
    "filter_columns",
    "keep_members",
    "monthly_counts",
    "page",
    "period_count",
    "period_counts",
    "preview",
    "ranked_page",
    "report_order",
    "reporting_calendar",
    "resolve_calendar",
    "rows_in_period",
    "sorted_by_keys",
    "top_n",
    "union_by_name",
    "with_growth",
    "with_rank",
]
