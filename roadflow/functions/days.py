"""Days of the week and hours of the day, on the stored local clock."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Day names and presets, Monday being 0.
DAY_NAMES = {
    "mon": 0, "monday": 0, "tue": 1, "tues": 1, "tuesday": 1, "wed": 2, "weds": 2, "wednesday": 2, "thu": 3, "thur": 3, "thurs": 3, "thursday": 3,
    "fri": 4, "friday": 4, "sat": 5, "saturday": 5, "sun": 6, "sunday": 6,
}
PRESETS = {"all": range(7), "weekday": range(5), "weekdays": range(5), "weekend": range(5, 7), "weekends": range(5, 7)}


def resolve_days(days) -> frozenset[int] | None:
    """The weekdays that a selector names; None for no filter. A selector is one token or several: a preset, a day's name or 0 to 6."""
    if days is None:
        return None
    try:
        tokens = [days] if isinstance(days, str) else list(days)
    except TypeError:
        tokens = [days]
    out: set[int] = set()
    for token in tokens:
        word = str(token).strip().lower()
        if word == "all":
            return None
        if word in PRESETS:
            out.update(PRESETS[word])
        elif word in DAY_NAMES:
            out.add(DAY_NAMES[word])
        elif word.lstrip("-").isdigit() and 0 <= int(word) <= 6:
            out.add(int(word))
        else:
            raise ValueError(f"no such day: {token!r}; use 0 (Monday) to 6, a day's name, 'weekday', 'weekend' or 'all'")
    if not out:
        raise ValueError("days= names no day")
    return frozenset(out)


def on_days(time: Column, days) -> Column | None:
    """The filter for a selector, or None."""
    chosen = resolve_days(days)
    return None if chosen is None else F.weekday(time).isin(*sorted(chosen))


def valid_hours(hours: Iterable[int], name: str) -> set[int]:
    out = {int(h) for h in hours}
    if wrong := sorted(h for h in out if not 0 <= h <= 23):
        raise ValueError(f"{name}: hours run from 0 to 23, not {wrong}")
    return out


def block_start(time: Column, block_hours: int) -> Column:
    hour = F.hour(time)
    return (hour - hour % block_hours).cast("int")


def block_label(start: Column, block_hours: int) -> Column:
    return F.format_string("%02d:00-%02d:00", start, F.least(start + block_hours, F.lit(24)))


def with_blocks(df: DataFrame, block_hours: int) -> DataFrame:
    return df.withColumn("block_start_hour", block_start(F.col("time"), block_hours))
