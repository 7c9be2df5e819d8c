"""Growth ratios and their display forms."""

from pyspark.sql import Column, functions as F

# Colours of the growth bands.
LOSS_COLOR = "red"
GAIN_COLOR = "green"


def growth(current: Column, earlier: Column) -> Column:
    """Growth as a fraction, null unless the earlier count is above zero."""
    return F.when(earlier > 0, current / earlier - 1)


def percent_text(fraction: Column) -> Column:
    """Percent with one decimal and grouped thousands, e.g. ``1,234.5%``; null stays null.

    Rounds the exact binary value, halves away from zero, as a browser's number
    formatting does. ``format_number`` sends exact halves to the even digit. Only
    values a quarter away from a half or whole number are exact halves here (x.25
    and x.75), so these get a nudge away from zero first.
    """
    percent = fraction * 100
    is_half = F.abs(percent) * 4 % 2 == 1
    nudged = F.when(is_half, percent + F.signum(percent) * 0.01).otherwise(percent)
    return F.concat(F.format_number(nudged, 1), F.lit("%"))


def growth_band(fraction: Column) -> Column:
    """``red`` up to and including zero, ``green`` above, null for null."""
    return F.when(fraction <= 0, LOSS_COLOR).when(fraction > 0, GAIN_COLOR)
