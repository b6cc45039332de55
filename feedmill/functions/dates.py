"""Date expressions.  All results are naive UTC (``timestamp_ntz``), whatever the session zone is."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

from feedmill import fixed_values as fv


def moment(as_of: datetime | str) -> datetime:
    """Accept a datetime or an ISO string; a zone is dropped, the wall time kept [X12]."""
    value = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return value.replace(tzinfo=None)


def literal_time(value: datetime | str) -> Column:
    """A ``timestamp_ntz`` literal; folded to a constant, so it reaches the Parquet scan."""
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def cutoff(as_of: datetime | str, hours: float) -> Column:
    """Start of the window of ``hours`` hours that ends at ``as_of``."""
    return literal_time(moment(as_of) - timedelta(hours=hours))


def _utc(instant: Column) -> Column:
    """Instant -> naive UTC through the epoch, exact across daylight-saving changes."""
    seconds = F.unix_micros(instant).cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(8,0)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


# Optional parts cover dates without time, without seconds, and numeric or named zones.
_RFC_FORMAT = "d MMM yyyy[ HH:mm[:ss]][ Z][ z]"
_IS_ISO = r"^\d{4}-\d{2}-\d{2}"


def _iso_instant(text: Column) -> Column:
    """ISO text as an instant; UTC is written in where the text names no zone, so the session zone never counts."""
    timed = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    zoned = F.regexp_replace(timed, r"^(\d{4}-\d{2}-\d{2}[Tt ][\d:.]+)$", "$1Z")
    return zoned.try_cast("timestamp")


def _rfc_instant(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")
    zoned = F.regexp_replace(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4}(?: \d{2}:\d{2}(?::\d{2})?)?)$", "$1 +0000")
    return F.try_to_timestamp(zoned, F.lit(_RFC_FORMAT))


def feed_date(text: Column) -> Column:
    """Feed date (RFC 822 or ISO 8601) -> naive UTC, NULL when unreadable [X11]."""
    clean = F.trim(text)
    return _utc(F.when(clean.rlike(_IS_ISO), _iso_instant(clean)).otherwise(_rfc_instant(clean)))


def iso_date(text: Column) -> Column:
    """ISO date or date-time -> naive UTC; a text without a zone is taken as it is, bad text is NULL [X8]."""
    return _utc(F.when(text.rlike(_IS_ISO), _iso_instant(text)))


def iso_wall_time(text: Column) -> Column:
    """ISO date argument with its zone dropped [X12]."""
    return F.when(text.rlike(_IS_ISO), text.try_cast("timestamp_ntz"))


def long_date(ts: Column) -> Column:
    """``December 04, 2025`` [X18]."""
    return F.date_format(ts, fv.LONG_DATE)


def short_date(ts: Column) -> Column:
    """``Dec 04, 2025`` [X18]."""
    return F.date_format(ts, fv.SHORT_DATE)
