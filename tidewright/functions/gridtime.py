"""Grid positions: a timestamp on a regular grid as a whole number, free of session time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
# 1970-01-01 was a Thursday; weeks start on Monday 1969-12-29.
_WEEK_SHIFT = 3 * 86400


def _seconds(ts: Column) -> Column:
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def position(ts: Column, freq: str) -> Column:
    """Slot number of ``ts`` on the grid ``freq`` (second … week, month, year)."""
    if freq == "month":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")
    if freq == "year":
        return F.year(ts).cast("long")
    if freq == "day":
        return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    shift = _WEEK_SHIFT if freq == "week" else 0
    return F.floor((_seconds(ts) + shift) / STEP_SECONDS[freq]).cast("long")


def slot_start(pos: Column, freq: str) -> Column:
    """First instant of slot ``pos`` as TIMESTAMP_NTZ; inverse of :func:`position`."""
    if freq == "month":
        year, month = F.floor(pos / 12).cast("int"), (F.pmod(pos, F.lit(12)) + 1).cast("int")
        return F.make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if freq == "year":
        return F.make_timestamp_ntz(pos.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = pos * STEP_SECONDS[freq] - (_WEEK_SHIFT if freq == "week" else 0)
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    return origin + F.make_dt_interval(
        days.cast("int"), F.floor(rest / 3600).cast("int"), F.floor((rest % 3600) / 60).cast("int"),
        (rest % 60).cast("decimal(18,6)"))


def floor_to(ts: Column, freq: str) -> Column:
    """``ts`` cut down to the start of its slot."""
    return slot_start(position(ts, freq), freq)


def from_parts(year: Column, month: Column, day: Column, hour: Column | None = None) -> Column:
    """Timestamp from separate calendar columns."""
    return F.make_timestamp_ntz(year, month, day, F.lit(0) if hour is None else hour, F.lit(0), F.lit(0))


def day_plus_hour(day: Column, hour: Column) -> Column:
    """Timestamp from a date column and an hour-of-day column."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int"))
