"""Parsers of tags and times, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadflow.functions.units import ALIASES, FACTORS

# Spellings of one-way tags.
ONEWAY_FORWARD = ("yes", "true", "1", "t")
ONEWAY_REVERSE = ("-1", "reverse")

_SPEED = r"^(\d+(?:\.\d+)?)\s*([a-z/_]*)$"


def parse_maxspeed(tag: Column) -> Column:
    """A posted limit in m/s: a number, bare for km/h or with a known unit; NULL for anything else and for 0."""
    text = F.lower(F.trim(tag.cast("string")))
    unit = F.regexp_extract(text, _SPEED, 2)
    factor = F.when(unit == "", F.lit(FACTORS["kph"]))
    for code, names in ALIASES.items():
        factor = factor.when(unit.isin(*names), F.lit(FACTORS[code]))
    speed = F.regexp_extract(text, _SPEED, 1).try_cast("double")
    return F.when(speed > 0, speed * factor)


def oneway(tag: Column) -> Column:
    """1 along the digitised direction, -1 against it, 0 both ways."""
    text = F.coalesce(F.lower(F.trim(tag.cast("string"))), F.lit(""))
    return F.when(text.isin(*ONEWAY_FORWARD), 1).when(text.isin(*ONEWAY_REVERSE), -1).otherwise(0)


_OFFSET = r"(?:[+-]\d{2}:?\d{2}|[zZ])$"
#: A time of day with an offset from UTC after it.
OFFSET = r"\d{2}:\d{2}.*" + _OFFSET


def parse_time(value: Column, *, timestamp_unit: str | None = None, tz: str | None = None) -> Column:
    """A TIMESTAMP_NTZ on the local clock.

    Numbers with a ``timestamp_unit`` (s, ms, us, ns) are epochs, so UTC. Text with an offset is converted to ``tz``, or keeps its own clock without one. Text without an offset
    keeps its clock, or counts as UTC if ``tz`` is given. Whatever does not parse is NULL.
    """
    local = (lambda t: F.convert_timezone(F.lit("UTC"), F.lit(tz), t)) if tz else (lambda t: t)
    if timestamp_unit is not None:
        per = {"s": 1_000_000.0, "ms": 1_000.0, "us": 1.0, "ns": 0.001}[timestamp_unit]
        micros = F.floor(value.try_cast("double") * per)
        whole = value.try_cast("long")
        exact = F.when(whole.cast("string") == value.cast("string"), whole * int(per) if per >= 1 else F.floor(whole / 1000))
        base = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return local(base + F.make_dt_interval(secs=(F.coalesce(exact, micros) / 1_000_000).cast("decimal(18,6)")))
    text = F.trim(value.cast("string"))
    has_offset = text.rlike(OFFSET)
    plain = F.regexp_replace(text, r"\s*" + _OFFSET, "")
    naive = F.when(has_offset, plain).otherwise(text).try_cast("timestamp_ntz")
    mark = F.regexp_extract(text, _OFFSET, 0)
    sign = F.when(mark.startswith("-"), -1).otherwise(1)
    hours, mins = F.regexp_extract(mark, r"[+-](\d{2})", 1).try_cast("int"), F.regexp_extract(mark, r"(\d{2})$", 1).try_cast("int")
    shift = F.when(F.upper(mark) == "Z", 0).otherwise(sign * (hours * 60 + mins))
    utc = naive - F.make_dt_interval(mins=shift)
    return F.when(has_offset, local(utc) if tz else naive).otherwise(local(naive))
