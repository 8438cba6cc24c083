"""Instrument clocks: OLE automation dates, C ``struct tm`` fields and UTC seconds."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N

# The OLE epoch is 1899-12-30; scan dates are accepted from day 2 to day 109574 (the year 2199).
OLE_UNIX_DAYS = 25569.0
OLE_RANGE = (2.0, 109574.0)


def ole_plausible(ole: Column) -> Column:
    return N.ge(ole, OLE_RANGE[0]) & N.le(ole, OLE_RANGE[1])


def ole_seconds(ole: Column) -> Column:
    """Seconds since 1970-01-01 on the OLE value's own clock, to the nearest second."""
    return F.when(ole_plausible(ole), F.round((ole - OLE_UNIX_DAYS) * 86400.0).cast("bigint"))


def ole_to_timestamp(ole: Column) -> Column:
    s = ole_seconds(ole)
    days = F.floor(s / 86400).cast("int")
    span = F.make_dt_interval(days, F.lit(0), F.lit(0), (s - days.cast("bigint") * 86400).cast("decimal(18,6)"))
    return F.when(s.isNotNull(), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span)


def utc_offset_minutes(ole_local: Column, utc_seconds: Column, strict: bool = True) -> Column:
    """Local minus UTC in minutes, to the nearest quarter hour. ``strict`` refuses an offset more than 120 s from a
    quarter hour or beyond 14 h; a zero or missing UTC time gives null."""
    diff = (ole_local - OLE_UNIX_DAYS) * 86400.0 - utc_seconds
    quarters = F.round(diff / 900.0)
    ok = ole_plausible(ole_local) & (utc_seconds != 0)
    if strict:
        ok = ok & (F.abs(diff - quarters * 900.0) <= 120.0) & (F.abs(quarters) <= 56.0)
    return F.when(ok, (quarters * 15).cast("int"))


def tm_to_timestamp(sec: Column, minute: Column, hour: Column, mday: Column, mon: Column, year: Column) -> Column:
    """C ``struct tm`` fields (month from 0, years since 1900); an impossible calendar date gives null."""
    ok = sec.between(0, 60) & year.between(0, 299)
    ts = F.try_make_timestamp_ntz((year + 1900).cast("int"), (mon + 1).cast("int"), mday.cast("int"),
                                  hour.cast("int"), minute.cast("int"),
                                  F.least(sec, F.lit(59)).cast("decimal(16,6)"))
    leap = F.when(sec == 60, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1).cast("decimal(18,6)")))
    return F.when(ok, F.coalesce(ts + leap, ts))


def reference_age_seconds(spectrum_ole: Column, reference_ole: Column) -> Column:
    """How old the white reference was when the sample was taken."""
    return F.when(ole_plausible(spectrum_ole) & ole_plausible(reference_ole),
                  (spectrum_ole - reference_ole) * 86400.0)
