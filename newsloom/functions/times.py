"""Times: what a source wrote, as UTC with a precision and a status; days of a time zone."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "%Y-%m-%dT%H:%M:%S.%fZ"
FIELDS = "utc string, range_start string, range_end string, precision string, status string"
#: How far a source's time may lie after its observation.
SLACK = timedelta(minutes=10)


def utc_text(ts: Column) -> Column:
    """A time in UTC as a text of 27 characters, in whose order times are ordered."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_window(day: Column, zone: str) -> tuple[Column, Column]:
    """The UTC times between which a calendar day of a zone lies, the end exclusive."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def _local(naive: datetime, zone: str) -> tuple[datetime | None, str]:
    """A wall clock's time in UTC; one that occurs twice or never when clocks change has no single answer."""
    tz = ZoneInfo(zone)
    both = [naive.replace(tzinfo=tz, fold=f) for f in (0, 1)]
    real = [x for x in both if x.astimezone(UTC).astimezone(tz).replace(tzinfo=None) == naive]
    if not real:
        return None, "nonexistent_local_time"
    if len({x.utcoffset() for x in real}) > 1:
        return None, "ambiguous_local_time"
    return real[0].astimezone(UTC), "valid"


def _bounds(start: datetime, end: datetime, zone: str) -> tuple[str, str] | None:
    a, z = _local(start, zone)[0], _local(end, zone)[0]
    return (a.strftime(FORMAT), z.strftime(FORMAT)) if a and z else None


def parse(raw: str | None, kind: str, zone: str | None, observed: str | None) -> tuple:
    """utc, range_start, range_end, precision, status of one value.

    kind: iso, feed, epoch_s, epoch_ms, date, month, or a strptime pattern. A time without a zone, its own or one given, is
    missing_timezone; one later than ten minutes after its observation is future_suspect. Dates and months are ranges.
    """
    text = (raw or "").strip()
    if not text:
        return None, None, None, "unknown", "missing"
    try:
        if kind in ("date", "month"):
            start = datetime.strptime(text, "%Y-%m-%d" if kind == "date" else "%Y-%m")
            if zone is None:
                return None, None, None, kind, "missing_timezone"
            end = start + timedelta(days=1) if kind == "date" else (start.replace(day=28) + timedelta(days=4)).replace(day=1)
            found = _bounds(start, end, zone)
            return (None, *found, kind, "valid") if found else (None, None, None, kind, "invalid")
        if kind in ("epoch_s", "epoch_ms"):
            at = datetime.fromtimestamp(0, UTC) + timedelta(**{"seconds" if kind == "epoch_s" else "milliseconds": float(text)})
        elif kind == "iso":
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        elif kind == "feed":
            at = parsedate_to_datetime(text)
        else:
            at = datetime.strptime(text, kind)
    except (ValueError, OverflowError, TypeError):
        return None, None, None, "unknown", "invalid"
    precision = "minute" if kind == "iso" and len(text.split("T")[-1].split("+")[0].rstrip("Z")) == 5 or "%" in kind and "%S" not in kind else "second"
    if at.tzinfo is None:
        if zone is None:
            return None, None, None, "unknown", "missing_timezone"
        at, status = _local(at, zone)
        if at is None:
            return None, None, None, precision, status
    utc = at.astimezone(UTC)
    seen = datetime.fromisoformat(observed.replace("Z", "+00:00")) if observed else None
    return utc.strftime(FORMAT), None, None, precision, "future_suspect" if seen and utc > seen + SLACK else "valid"


def source_time():
    """A vectorised function of raw, kind, zone, observed: see parse."""
    @F.pandas_udf(FIELDS)
    def f(raw: pd.Series, kind: pd.Series, zone: pd.Series, observed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(*x) for x in zip(raw, kind, zone, observed, strict=True)], columns=[x.split()[0] for x in FIELDS.split(", ")], dtype="object")

    return f
