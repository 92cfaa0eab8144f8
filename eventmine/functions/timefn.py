"""Time helpers that stay on the JVM and do not depend on the session zone.

Event times are TIMESTAMP_NTZ. ``timestampdiff`` / ``timestampadd`` work on
NTZ directly, so microsecond arithmetic gives the same numbers on every
cluster whatever its time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000,
          "d": 86_400_000_000}


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c)


def from_micros(c: str | Column) -> Column:
    """Inverse of :func:`micros`; gives TIMESTAMP_NTZ."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", c, F.expr(EPOCH_NTZ))


def duration_us(spec: str | int | _dt.timedelta) -> int:
    """'8h', '30m', '7d', '90s', 1500 (micros) or a timedelta → microseconds."""
    if isinstance(spec, int):
        return spec
    if isinstance(spec, _dt.timedelta):
        return (spec.days * 86_400 + spec.seconds) * 1_000_000 + spec.microseconds
    s = spec.strip().lower()
    for unit in ("us", "ms", "s", "m", "h", "d"):
        if s.endswith(unit) and s[: -len(unit)].replace(".", "", 1).isdigit():
            return int(float(s[: -len(unit)]) * MICROS[unit])
    raise ValueError(f"cannot read duration {spec!r}")


def floor_div(c: Column, n: int) -> Column:
    """Floor of ``c / n`` for a BIGINT column and a positive constant, exact
    at bucket edges and for negative values: the dividend is made an exact
    multiple of ``n`` first (``pmod`` is never negative), so the quotient is
    an exact integer for any |c| below 2^53 (about 285 years of microseconds
    either side of 1970)."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("bigint")


def ntz_literal(ts: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session zone."""
    if isinstance(ts, _dt.datetime):
        ts = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"timestamp_ntz'{ts}'")


def ntz_array(values: list[str]) -> Column:
    return F.array(*[ntz_literal(v) for v in values])


def to_event_time(c: str | Column) -> Column:
    """NTZ → TIMESTAMP, needed by watermarks. Wall-clock reading is kept when
    the session zone is UTC (``session.REQUIRED_CONF``)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")
