"""Engineering units: spelling, dimension, and conversion to a dimension's base unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSI_PA = 6894.757293168
FAHRENHEIT = 5.0 / 9.0

# Fixed values. Per dimension: unit key -> (scale, offset) with base = value * scale + offset.
UNIT_TABLE: dict[str, dict[str, tuple[float, float]]] = {
    "pressure": {
        "pa": (1.0, 0.0), "kpa": (1e3, 0.0), "mpa": (1e6, 0.0), "bar": (1e5, 0.0), "mbar": (100.0, 0.0),
    },
    "pressure_absolute": {
        "pa(abs)": (1.0, 0.0), "kpa(abs)": (1e3, 0.0), "bar(abs)": (1e5, 0.0), "bar(a)": (1e5, 0.0),
        "psia": (PSI_PA, 0.0),
    },
    "pressure_gauge": {
        "pa(g)": (1.0, 0.0), "kpa(g)": (1e3, 0.0), "bar(g)": (1e5, 0.0), "psig": (PSI_PA, 0.0),
    },
    "temperature": {
        "degc": (1.0, 0.0), "c": (1.0, 0.0), "oc": (1.0, 0.0), "celsius": (1.0, 0.0),
        "k": (1.0, -273.15), "kelvin": (1.0, -273.15),
        "degf": (FAHRENHEIT, -32.0 * 5.0 / 9.0), "f": (FAHRENHEIT, -32.0 * 5.0 / 9.0),
    },
    "flow": {
        "m3/s": (1.0, 0.0), "m3/h": (1.0 / 3600.0, 0.0), "l/s": (1e-3, 0.0), "l/min": (1.0 / 60000.0, 0.0),
        "l/h": (1.0 / 3_600_000.0, 0.0),
    },
    "ratio": {
        "1": (1.0, 0.0), "fraction": (1.0, 0.0), "ratio": (1.0, 0.0),
        "%": (0.01, 0.0), "percent": (0.01, 0.0), "percentage": (0.01, 0.0),
    },
    "voltage": {"v": (1.0, 0.0), "mv": (1e-3, 0.0), "kv": (1e3, 0.0)},
    "current": {"a": (1.0, 0.0), "ma": (1e-3, 0.0), "ka": (1e3, 0.0)},
    "power": {"w": (1.0, 0.0), "kw": (1e3, 0.0), "mw": (1e6, 0.0)},
    "frequency": {"hz": (1.0, 0.0), "khz": (1e3, 0.0)},
    "rotational_speed": {"rpm": (1.0, 0.0)},
    "length": {"m": (1.0, 0.0), "cm": (1e-2, 0.0), "mm": (1e-3, 0.0)},
}

# Spelling variants folded away before lookup, applied in this order.
SPELLING = ((" ", ""), ("°", "deg"), ("³", "3"), ("^", ""))


def fold_text(unit: str) -> str:
    """Lookup key of a unit given as a Python string."""
    key = str(unit).strip().casefold()
    for old, new in SPELLING:
        key = key.replace(old, new)
    return key


def fold_column(unit: Column) -> Column:
    """Lookup key of a unit column."""
    key = F.lower(F.regexp_replace(unit.cast("string"), r"^\s+|\s+$", ""))
    for old, new in SPELLING:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def unit_rows() -> list[tuple[str, str, float, float]]:
    """The table as (key, dimension, scale, offset) rows; its size is fixed."""
    return [
        (key, dimension, scale, offset)
        for dimension, members in UNIT_TABLE.items()
        for key, (scale, offset) in members.items()
    ]


def find_unit(unit: str) -> tuple[str, float, float] | None:
    """(dimension, scale, offset) of a unit, or None when it is not known."""
    key = fold_text(unit)
    for dimension, members in UNIT_TABLE.items():
        if key in members:
            return (dimension, *members[key])
    return None
