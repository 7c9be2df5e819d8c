"""Reading and writing of tables."""

from tallytide.sources.curated import CURATED_SCHEMA, read_curated, write_csv, write_curated
from tallytide.sources.extracts import (
    EXTRACT_SCHEMA,
    REJECT_SCHEMA,
    read_extracts,
    split_extracts,
)
from tallytide.sources.months import finish_replacing, stored_months

__all__ = [
    "CURATED_SCHEMA",
    "EXTRACT_SCHEMA",
    "REJECT_SCHEMA",
    "finish_replacing",
    "read_curated",
    "read_extracts",
    "split_extracts",
    "stored_months",
    "write_csv",
    "write_curated",
]
