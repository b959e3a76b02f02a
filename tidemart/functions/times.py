"""Epochs, date strings and window bounds, always in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = "yyyy-MM-dd HH:mm:ss"


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_date_text(ms: Column) -> Column:
    return F.date_format(from_millis(ms), "yyyy-MM-dd")


def to_time_text(ms: Column) -> Column:
    return F.date_format(from_millis(ms), SECONDS)


def parse(text: Column) -> Column:
    """A timestamp from a date, a date with time, or an ISO time with 1 to 9 digits of fraction; null if it is none of them."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(SECONDS)), F.try_to_timestamp(text))


def to_millis(text: Column) -> Column:
    return F.unix_millis(parse(text))


def date_part(text: Column) -> Column:
    """The ``yyyy-MM-dd`` in front of a date and time."""
    return F.split_part(text, F.lit(" "), F.lit(1))


def bounds(window: str = "window") -> list[Column]:
    """The window's start and end as text: ``stt`` and ``edt``."""
    return [F.date_format(F.col(f"{window}.{end}"), SECONDS).alias(name) for end, name in (("start", "stt"), ("end", "edt"))]
