"""Event time and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.fields import WHITESPACE, EventFields, number_from_text

# The fields searched for an event's time, in order.
TIME_FIELDS = ("_time", "@timestamp", "timestamp", "TimeGenerated", "UtcTime", "event_time")
# Magnitude above which an epoch number is in that unit.
EPOCH_UNITS = ((1e17, 1e9), (1e14, 1e6), (1e11, 1e3))
# Seconds per duration unit.
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}

# ISO date, date and time, or date and hour, with an optional zone.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_US_STYLE = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]$"


def micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(1e6)).cast("bigint")


def epoch_to_timestamp(number: Column) -> Column:
    scaled = number
    for above, divisor in reversed(EPOCH_UNITS):
        scaled = F.when(number > above, number / divisor).otherwise(scaled)
    sane = F.abs(scaled) <= F.lit(2.5e11)
    return F.when(sane, F.timestamp_micros(micros(scaled)))


def parse_time(text: Column) -> Column:
    """Timestamp from text, NULL when it cannot be read.

    Reads epoch seconds, milliseconds, microseconds or nanoseconds by magnitude, ISO dates
    and times with or without a zone (UTC without one), and ``m/d/yyyy h:m:s AM``.
    """
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    number = number_from_text(F.when(~trimmed.rlike("^(?i)-?0x"), trimmed))
    dotted = F.regexp_replace(trimmed, ",", ".")
    short_zone = F.regexp_replace(dotted, r"([T ]\d{2}.*[+-]\d{2})(\d{2})$", "$1:$2")
    hour_only = F.regexp_replace(short_zone, r"^(.{10}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(F.isnotnull(number) & ~F.isnan(number), epoch_to_timestamp(number)).when(
        trimmed.rlike(_ISO), F.try_to_timestamp(hour_only)
    ).when(
        trimmed.rlike(_US_STYLE), F.try_to_timestamp(F.upper(trimmed), F.lit("M/d/yyyy h:m:s a"))
    )


def event_time(fields: EventFields, names: tuple[str, ...] = TIME_FIELDS) -> Column:
    """The first of the time fields that can be read."""
    # Inside a lambda the parser's expression stands once, not once per field: less code to compile.
    read = F.transform(F.array(*[fields.locate(name).text for name in names]), parse_time)
    return F.get(F.filter(read, lambda at: at.isNotNull()), 0)


_DURATION = re.compile(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])?\s*")


def seconds_of(value: str | float | None, default: float | None = None) -> float:
    """Rule-file durations: ``90s``, ``500ms``, ``5m``, ``1h30m``, ``1h 30m`` or a bare number of seconds."""
    if type(value) in (int, float):
        return float(value)
    text = str(value if value is not None else "").strip().lower()
    total, at = 0.0, 0
    while step := _DURATION.match(text, at):
        total, at = total + float(step[1]) * UNIT_SECONDS[step[2] or "s"], step.end()
    if text and at == len(text):
        return total
    if default is None:
        raise ValueError(f"not a duration: {value!r}")
    return default
