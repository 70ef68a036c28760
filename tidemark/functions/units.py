"""Unit conversions and duration text as column expressions."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(interval: str | int) -> int:
    """Microseconds of an interval such as ``"5 minutes"``; integers pass unchanged."""
    return interval if isinstance(interval, int) else int(pd.Timedelta(interval).value // 1000)


def instant(value: Column | datetime) -> Column:
    """A point in time as a column; a datetime without zone is UTC."""
    if isinstance(value, Column):
        return value
    aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    delta = aware - epoch
    return F.timestamp_micros(F.lit((delta.days * 86400 + delta.seconds) * 1000000 + delta.microseconds))


def whole_div(a: Column, b: int) -> Column:
    """Integer division of a long column, rounding down also below zero."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def millis_to_seconds(c: Column | str, whole: bool = False) -> Column:
    return whole_div(_col(c).cast("long"), 1000) if whole else _col(c) / F.lit(1000.0)


def nanos_to_millis(c: Column | str) -> Column:
    return _col(c) / F.lit(1e6)


def bytes_to_megabytes(c: Column | str) -> Column:
    return _col(c) / F.lit(1048576.0)


def per_minute(c: Column | str) -> Column:
    return _col(c) * F.lit(60.0)


def ratio_percent(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100``; null when the whole is zero."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double")) * F.lit(100.0)


def years_to_millis(years: Column | str) -> Column:
    """Years of 365.25 days in milliseconds; -1 (keep for ever) passes unchanged."""
    y = _col(years)
    return F.when(y == -1, F.lit(-1).cast("long")).otherwise(y.cast("long") * F.lit(31557600000))


def duration_text(seconds: Column | str) -> Column:
    """``1h 1m`` / ``2m 5s`` / ``45s``."""
    s = _col(seconds).cast("long")
    hours, minutes, rest = whole_div(s, 3600), whole_div(F.pmod(s, F.lit(3600)), 60), F.pmod(s, F.lit(60))
    return (
        F.when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(minutes > 0, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(rest, F.lit("s")))
    )
