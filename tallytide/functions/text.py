"""Text labels."""

from pyspark.sql import Column, functions as F


def joined_label(*parts: Column, sep: str = " ", missing: str = "NA") -> Column:
    """Parts joined by ``sep``, with ``missing`` in place of a null part."""
    return F.concat_ws(sep, *(F.coalesce(part, F.lit(missing)) for part in parts))
