"""Wall clocks, civil dates, calendar buckets and time zones as column expressions.

Source wall clocks are ``TIMESTAMP_NTZ``.  The expressions below never go through the
session time zone for such columns, so results do not depend on where the job runs.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = date(1970, 1, 1)
# Peak hours of the slice report.
MORNING_PEAK = (7, 8, 9)
EVENING_PEAK = (17, 18, 19)


def wall(value: datetime | Column) -> Column:
    """A wall clock literal that means the same in every time zone."""
    return F.lit(value.isoformat(" ")).cast("timestamp_ntz") if isinstance(value, datetime) else value


def day_number(day: Column) -> Column:
    """Days since 1970-01-01 of a date or wall clock."""
    return F.datediff(day, F.lit(EPOCH))


def second_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch on the wall clock of the column."""
    return day_number(ts).cast("bigint") * 86400 + second_of_day(ts)


def wall_instant(seconds: Column) -> Column:
    """Inverse of :func:`wall_seconds`."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def bucket_start(ts: Column, granularity: str) -> Column:
    """Start of the hourly, daily or monthly bucket that holds ``ts``."""
    day = F.to_date(ts)
    if granularity == "hourly":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))
    if granularity == "daily":
        return day.cast("timestamp_ntz")
    if granularity == "monthly":
        return F.trunc(day, "month").cast("timestamp_ntz")
    raise ValueError(f"unsupported granularity {granularity!r}")


def step(start: Column, granularity: str, steps: Column | int) -> Column:
    """Move a bucket start by whole buckets: elapsed hours, calendar days or months."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    if granularity == "hourly":
        return start + F.make_dt_interval(hours=steps)
    if granularity == "daily":
        return F.date_add(F.to_date(start), steps).cast("timestamp_ntz")
    if granularity == "monthly":
        return F.add_months(F.to_date(start), steps).cast("timestamp_ntz")
    raise ValueError(f"unsupported granularity {granularity!r}")


def clock_seconds(text: Column) -> Column:
    """Service-day clock ``H:MM:SS`` (hours below 72) to seconds; NULL when malformed."""
    parts = F.split(text, ":")
    value = (
        F.get(parts, F.lit(0)).try_cast("int") * 3600
        + F.get(parts, F.lit(1)).try_cast("int") * 60
        + F.get(parts, F.lit(2)).try_cast("int")
    )
    shaped = text.rlike(r"^\d{1,2}:[0-5]\d:[0-5]\d$")
    return F.when(shaped & (value < 72 * 3600), value)


def normalize_timestamp(text: Column, zone: str = "Europe/Moscow", fmt: str | None = None,
                        assume_zone: str | None = None) -> Column:
    """Local wall clock of an instant given as text; NULL when it cannot be placed.

    Text with an offset is an instant.  Text without one is placed only when
    ``assume_zone`` names the zone it was written in.
    """
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    if fmt is None:
        shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
        instant = F.try_to_timestamp(F.when(shaped & has_offset, text))
        naive = F.when(shaped & ~has_offset, text).try_cast("timestamp_ntz")
    else:
        instant = F.lit(None).cast("timestamp")
        naive = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    utc = F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    if assume_zone is None:
        return local
    return F.coalesce(local, F.convert_timezone(F.lit(assume_zone), F.lit(zone), naive))


def resolve_local(ts: Column, zone: str) -> Column:
    """``ok``, ``nonexistent`` or ``ambiguous`` for a wall clock in a zone.

    A wall clock that does not survive the trip to UTC and back fell into a skipped
    hour; one whose neighbour an hour later or earlier shares the UTC instant distance
    of zero or two hours sits in a repeated hour.
    """
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)

    def local_of(shift: int) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.make_dt_interval(hours=F.lit(shift)))

    repeated = (local_of(1) == ts) | (local_of(-1) == ts)
    return F.when(back != ts, "nonexistent").when(repeated, "ambiguous").otherwise("ok")


def day_type(day: Column, off: Iterable[date] = (), work: Iterable[date] = ()) -> Column:
    """0 working day, 1 Saturday, 2 Sunday or holiday; exceptions win over the weekday."""
    off, work = list(off), list(work)
    is_off = day.isin(off) if off else F.lit(False)
    is_work = day.isin(work) if work else F.lit(False)
    weekday = F.weekday(day)
    return (
        F.when(is_work | ((weekday < 5) & ~is_off), 0)
        .when((weekday == 5) & ~is_off, 1)
        .otherwise(2)
    )


def daypart(hour: Column) -> Column:
    """Peak labels of an hourly bucket."""
    return (
        F.when(hour.isin(list(MORNING_PEAK)), "morning_peak")
        .when(hour.isin(list(EVENING_PEAK)), "evening_peak")
        .otherwise("offpeak")
    )


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def calendar_columns(start: Column, granularity: str) -> dict[str, Column]:
    """Calendar attributes of a bucket; never missing."""
    day = F.to_date(start)
    weekday, month = F.weekday(day), F.month(day)
    month_days = F.dayofmonth(F.last_day(day))
    common = {
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "day_of_month": F.dayofmonth(day),
        "day_of_year": F.dayofyear(day),
        "month_of_year": month,
    }
    if granularity == "hourly":
        return {"hour_of_day": F.hour(start), "hour_of_week": weekday * 24 + F.hour(start),
                **common, "bucket_hours": F.lit(1)}
    if granularity == "daily":
        return {**common, "days_in_month": month_days,
                "is_month_start": (F.dayofmonth(day) == 1).cast("int"),
                "is_month_end": (F.dayofmonth(day) == month_days).cast("int"),
                "bucket_hours": F.lit(24)}
    if granularity == "monthly":
        leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
        return {"month_of_year": month, "quarter_of_year": F.quarter(day),
                "days_in_month": month_days, "is_leap_year": leap.cast("int"),
                "bucket_days": month_days, "bucket_hours": month_days * 24}
    raise ValueError(f"unsupported granularity {granularity!r}")
