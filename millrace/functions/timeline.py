"""Epoch-microsecond arithmetic and duration options."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

_UNIT_US = {"s": SECOND_US, "m": MINUTE_US, "min": MINUTE_US, "h": HOUR_US}
_DURATION = re.compile(r"^(?P<amount>.*?)(?P<unit>min|s|m|h)$", re.S)


def duration_us(text: object, marker: int = 2) -> int:
    """Microseconds in a duration such as ``30s``, ``1.5min`` or ``1h``.

    ``marker=1`` is the older reading, which drops the fraction of a minute and
    never goes below one minute.
    """
    if marker not in (1, 2):
        raise ValueError(f"Unknown duration marker {marker}")
    found = _DURATION.match(str(text).strip().lower())
    if not found:
        raise ValueError(f"Duration {text!r} needs a unit: s, m, min or h")
    span = float(found["amount"]) * _UNIT_US[found["unit"]]
    if not math.isfinite(span) or span < 1:
        raise ValueError(f"Duration {text!r} is not a finite span of a microsecond or more")
    if marker == 1:
        return max(1, int(span / MINUTE_US)) * MINUTE_US
    return int(round(span))


def epoch_us(column: Column | str) -> Column:
    """Epoch microseconds of a timestamp, with or without a zone."""
    source = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(source.cast("timestamp"))


def floor_to(column: Column | str, step: int) -> Column:
    """Largest multiple of ``step`` not above the value; right for negative values too."""
    source = F.col(column) if isinstance(column, str) else column
    return source - F.pmod(source, F.lit(step).cast("bigint"))


def floor_div(column: Column | str, step: int) -> Column:
    """Floor division of a bigint by a positive constant, without leaving integer arithmetic."""
    return F.call_function("div", floor_to(column, step), F.lit(step).cast("bigint"))


def iso_utc(us: Column | str) -> Column:
    """ISO-8601 text with a +00:00 offset; fractional digits only when there are any."""
    moment = F.timestamp_micros(F.col(us) if isinstance(us, str) else us)
    raw = F.col(us) if isinstance(us, str) else us
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.pmod(raw, F.lit(SECOND_US)) == 0, whole).otherwise(fine), F.lit("+00:00"))
