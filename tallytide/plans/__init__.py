"""Reports composed from the operators: the entry points of the library."""

from tallytide.plans.curate import build_curated, curate, make_model_list
from tallytide.plans.dashboard import Dashboard, dashboard
from tallytide.plans.display import display, display_labels, display_page, display_report
from tallytide.plans.kept import kept_counts, kept_dashboard, update_counts
from tallytide.plans.summary import (
    FUEL_KEYS,
    MAKE_KEYS,
    MEASURES,
    MODEL_KEYS,
    summary,
    summary_page,
)
from tallytide.plans.trends import top_make_trend, top_model_trend, trend

__all__ = [
    "FUEL_KEYS",
    "MAKE_KEYS",
    "MEASURES",
    "MODEL_KEYS",
    "Dashboard",
    "build_curated",
    "curate",
    "dashboard",
    "display",
    "display_labels",
    "display_page",
    "display_report",
    "kept_counts",
    "kept_dashboard",
    "make_model_list",
    "summary",
    "summary_page",
    "top_make_trend",
    "top_model_trend",
    "trend",
    "update_counts",
]
