"""Periods of years and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of periods, as (first year, label) in order; years before the first have the label at the end.
SCHEMES: dict[str, tuple[tuple[tuple[int, str], ...], str | None]] = {
    "two_years": (((2023, "2023-2024"), (2025, "2025-2026")), None),
    "year_to_date": (((2024, "2024"), (2025, "2025"), (2026, "2026 YTD")), "2022-2023"),
    "hypothesis": (((2024, "2024"), (2025, "2025-2026")), "pre-2024"),
    "authority": (((2023, "2023-2024"), (2025, "2025-2026")), "other"),
}


def period(year: Column, scheme: str) -> Column:
    """The label of a year in one of the schemes; null years have none."""
    starts, before = SCHEMES[scheme]
    out = F.when(year < starts[0][0], F.lit(before))
    for (first, label), (end, _) in zip(starts, [*starts[1:], (9999, "")], strict=True):
        out = out.when((year >= first) & (year < end), label)
    return out


def period_sql(year: str, scheme: str) -> str:
    """period() in SQL."""
    starts, before = SCHEMES[scheme]
    cases = [f"when {year} < {starts[0][0]} then {'null' if before is None else repr(before)}"]
    return "case " + " ".join(cases + [f"when {year} < {end} then '{label}'" for (_, label), (end, _) in zip(starts, [*starts[1:], (9999, "")], strict=True)]) + " end"


def year_label(year: Column, last: Column) -> Column:
    """A year as text; the last one is marked as not over."""
    return F.when(year == last, F.concat(year.cast("string"), F.lit(" YTD"))).otherwise(year.cast("string"))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage text; a dash for null, and `<1%` for what would round to less than one percent though it is not 0."""
    small = F.lit("<1%")
    return F.when(share.isNull() | F.isnan(share), "—").when((share > 0) & (share < 0.01), small).otherwise(F.concat(F.format_number(share * 100, digits), F.lit("%")))


def number(value: Column) -> Column:
    """A whole number with separators; a dash for null."""
    return F.coalesce(F.format_number(value.cast("bigint"), 0), F.lit("—"))
