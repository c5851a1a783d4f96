"""Time text in and out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: datetime) -> Column:
    """A naive time as the session's clock reads it, whatever the client's time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def syslog_timestamp(text: Column, reference_ts: datetime, rollover: bool = False) -> Column:
    """Parse ``Mon D HH:MM:SS``, which has no year, in the year of ``reference_ts``.

    A date that does not exist gives null. With ``rollover`` a time more than a
    day after ``reference_ts`` belongs to the year before (December lines read
    in January).
    """
    plain = F.regexp_replace(text, r"(?U)\s+", " ")

    def in_year(year: int) -> Column:
        stamped = F.concat_ws(" ", F.lit(str(year)), plain)
        return F.try_to_timestamp(stamped, F.lit("yyyy MMM d H:m:s"))

    this_year = in_year(reference_ts.year)
    if not rollover:
        return this_year
    latest = instant(reference_ts) + F.expr("INTERVAL 1 DAY")
    return F.when(
        this_year.isNull() | (this_year > latest), in_year(reference_ts.year - 1)
    ).otherwise(this_year)


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def sunday_first_day(ts: Column) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(ts) - 1
