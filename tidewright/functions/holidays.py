"""United States federal holidays, generated from rules for any span of years."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# Month and day, or month, weekday (0 = Monday) and which one (-1 = last).
FIXED = {"New Year's Day": (1, 1), "Independence Day": (7, 4), "Veterans Day": (11, 11), "Christmas Day": (12, 25)}
FLOATING = {"Martin Luther King Day": (1, 0, 3), "Washington's Birthday": (2, 0, 3), "Memorial Day": (5, 0, -1),
            "Labor Day": (9, 0, 1), "Columbus Day": (10, 0, 2), "Thanksgiving": (11, 3, 4)}
JUNETEENTH_FROM = 2021


def _nth(year: int, month: int, weekday: int, which: int) -> date:
    if which > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (which - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def us_holidays(first_year: int, last_year: int) -> list[tuple[date, str]]:
    """Holiday dates with observed days (Saturday → Friday, Sunday → Monday) listed beside the real ones."""
    out = []
    for year in range(first_year, last_year + 2):
        days = {n: date(year, m, d) for n, (m, d) in FIXED.items()}
        days |= {n: _nth(year, *rule) for n, rule in FLOATING.items()}
        if year >= JUNETEENTH_FROM:
            days["Juneteenth"] = date(year, 6, 19)
        for name, day in days.items():
            out.append((day, name))
            if day.weekday() >= 5 and name not in FLOATING:
                out.append((day + timedelta(1 if day.weekday() == 6 else -1), name + " (observed)"))
    return sorted(x for x in out if first_year <= x[0].year <= last_year)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """About twelve rows a year: safe to broadcast for any span of calendar years."""
    return spark.createDataFrame(us_holidays(first_year, last_year), "day date, holiday string").groupBy("day").agg(
        {"holiday": "min"}).withColumnRenamed("min(holiday)", "holiday")
