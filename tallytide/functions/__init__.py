"""Column expressions: dates, categories, growth and labels."""

from tallytide.functions.categories import (
    FUEL_GROUPS,
    NATIONAL_MAKERS,
    OTHER_GROUP,
    maker_class,
    regroup,
)
from tallytide.functions.dates import (
    month_label,
    month_start,
    shift_months,
    shift_years,
    year_start,
    ytd_label,
)
from tallytide.functions.growth import growth, growth_band, percent_text
from tallytide.functions.text import joined_label

__all__ = [
    "FUEL_GROUPS",
    "NATIONAL_MAKERS",
    "OTHER_GROUP",
    "growth",
    "growth_band",
    "joined_label",
    "maker_class",
    "month_label",
    "month_start",
    "percent_text",
    "regroup",
    "shift_months",
    "shift_years",
    "year_start",
    "ytd_label",
]
