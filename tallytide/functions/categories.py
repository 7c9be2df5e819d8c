"""Regrouping of codes into report categories."""

from collections.abc import Collection, Mapping

from pyspark.sql import Column, functions as F

# Fuel codes and their groups, and the makers counted as national with the
# names of the two classes.
FUEL_GROUPS = {
    "petrol": "Petrol",
    "greendiesel": "Diesel",
    "diesel": "Diesel",
    "electric": "BEV",
    "hybrid_petrol": "Hybrid",
    "hybrid_diesel": "Hybrid",
}
OTHER_GROUP = "Others"
NATIONAL_MAKERS = ("Perodua", "Proton")
NATIONAL = "National"
NON_NATIONAL = "Non-National"


def regroup(
    code: Column,
    groups: Mapping[str, str] = FUEL_GROUPS,
    other: str = OTHER_GROUP,
) -> Column:
    """Group of a code; unknown, differently cased and null codes are ``other``."""
    members: dict[str, list[str]] = {}
    for member, group in groups.items():
        members.setdefault(group, []).append(member)
    grouped = F
    for group, codes in members.items():
        grouped = grouped.when(code.isin(codes), group)
    return grouped.otherwise(other) if members else F.lit(other)


def maker_class(maker: Column, national: Collection[str] = NATIONAL_MAKERS) -> Column:
    """``National`` or ``Non-National``; a null maker is ``Non-National``."""
    return F.when(maker.isin(list(national)), NATIONAL).otherwise(NON_NATIONAL)
