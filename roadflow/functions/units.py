"""Speed units. Every speed inside the engine is in metres per second; conversion happens where data come in or go out."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per second of one unit, and the spellings of each unit.
FACTORS = {"mph": 1609.344 / 3600.0, "kph": 1000.0 / 3600.0, "mps": 1.0}
ALIASES = {
    "mph": ("mph", "mi/h", "miles_per_hour"),
    "kph": ("kph", "km/h", "kmh", "kmph", "kilometers_per_hour", "kilometres_per_hour"),
    "mps": ("mps", "m/s", "ms", "meters_per_second", "metres_per_second"),
}
_CODES = {alias: code for code, names in ALIASES.items() for alias in names}


class SpeedUnit(str, Enum):
    MPH = "mph"
    KPH = "kph"
    MPS = "mps"

    @classmethod
    def parse(cls, value: str | SpeedUnit) -> SpeedUnit:
        if isinstance(value, cls):
            return value
        code = _CODES.get(str(value).strip().lower())
        if code is None:
            raise ValueError(f"unknown speed unit {value!r}: use mph, kph or mps")
        return cls(code)


def to_mps(speed, unit: str | SpeedUnit):
    """A number or Column in ``unit``, in m/s."""
    unit = SpeedUnit.parse(unit)
    return speed if unit is SpeedUnit.MPS else speed * (F.lit(FACTORS[unit.value]) if isinstance(speed, Column) else FACTORS[unit.value])


def from_mps(speed, unit: str | SpeedUnit):
    """A number or Column in m/s, in ``unit``. Divides, so that a round trip is exact to the last bit or nearly so."""
    unit = SpeedUnit.parse(unit)
    return speed if unit is SpeedUnit.MPS else speed / (F.lit(FACTORS[unit.value]) if isinstance(speed, Column) else FACTORS[unit.value])


def finite(c: Column) -> Column:
    """The number, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def usable_speed(c: Column) -> Column:
    """The number where it is finite and positive, else NULL."""
    return F.when(finite(c) > 0, c)


def unit_of_name(column: str) -> str | None:
    """The unit code that a column's name ends in, as ``speed_kmh`` or ``Speed (km/h)``."""
    low = column.strip().lower()
    return next((code for alias, code in _CODES.items() if low == alias or low.endswith((f"_{alias}", f"({alias})"))), None)
