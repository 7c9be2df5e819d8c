"""All reports of the dashboard from one scan of the facts."""

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame

from tallytide.operators.calendar import Calendar, resolve_calendar
from tallytide.operators.counts import monthly_counts
from tallytide.plans.curate import make_model_list
from tallytide.plans.summary import FUEL_KEYS, MAKE_KEYS, MODEL_KEYS, summary
from tallytide.plans.trends import top_make_trend, top_model_trend, trend
from tallytide.shared import written


class Dashboard:
    """The calendar, and a summary and a trend for each page, built when first asked for."""

    def __init__(self, cube: DataFrame, calendar: Calendar, n: int, dedup: bool):
        self.cube, self.calendar, self.n, self.dedup = cube, calendar, n, dedup
        self._options = {"as_of": calendar, "date": "month", "weight": "registration"}

    @cached_property
    def makes(self) -> DataFrame:
        return summary(self.cube, MAKE_KEYS, **self._options)

    @cached_property
    def make_trend(self) -> DataFrame:
        return top_make_trend(self.cube, self.n, **self._options)

    @cached_property
    def models(self) -> DataFrame:
        return summary(self.cube, MODEL_KEYS, **self._options)

    @cached_property
    def model_trend(self) -> DataFrame:
        return top_model_trend(self.cube, self.n, dedup=self.dedup, **self._options)

    @cached_property
    def fuels(self) -> DataFrame:
        return summary(self.cube, FUEL_KEYS, **self._options)

    @cached_property
    def fuel_trend(self) -> DataFrame:
        return trend(self.cube, FUEL_KEYS, "month", "registration")

    @cached_property
    def make_models(self) -> DataFrame:
        """Every make and model of the facts."""
        return make_model_list(self.cube)


def dashboard(
    facts: DataFrame,
    as_of: dt.date | str | None = None,
    n: int = 10,
    dedup: bool = False,
    date: str = "date_reg",
) -> Dashboard:
    """Every page, computed from the monthly counts of the finest keys.

    The facts are read once and reduced to one row per month, make, model and fuel group;
    that table is written to the shared folder and all pages add up its counts.
    """
    cube = written(monthly_counts(facts, MODEL_KEYS, date))
    return Dashboard(cube, resolve_calendar(cube, as_of, "month"), n, dedup)
