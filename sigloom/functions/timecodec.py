"""Conversions between numeric epochs and packed or written times, all as column expressions (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: seconds from the 1958 epoch to the Unix epoch; day number of the Unix epoch counted from year 0; OLE days' epoch in seconds
TAI_OFFSET = 378691200
DATENUM_OFFSET = 719529
OLE_OFFSET = 2209161600
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")


def unixtime() -> Column:
    """Seconds since 1970, now (one value for a query)."""
    return F.current_timestamp().cast("double")


def unix_to_datetime(t: Column) -> Column:
    """A timestamp (UTC) of seconds since 1970."""
    return F.timestamp_micros(F.round(t * 1000000).cast("long"))


def datetime_to_unix(at: Column) -> Column:
    return F.unix_micros(at) / 1000000


def unix_to_tai(t: Column) -> Column:
    return t + TAI_OFFSET


def tai_to_unix(t: Column) -> Column:
    return t - TAI_OFFSET


def unix_to_taim(t: Column) -> Column:
    """Whole TAI minutes."""
    return F.floor((t + TAI_OFFSET) / 60).cast("long")


def taim_to_unix(m: Column) -> Column:
    return m * 60 - TAI_OFFSET


def taim_text_to_unix(s: Column) -> Column:
    """"minutes:milliseconds" in seconds."""
    return F.split_part(s, F.lit(":"), F.lit(1)).cast("double") * 60 + F.coalesce(F.split_part(s, F.lit(":"), F.lit(2)).try_cast("double"), F.lit(0.0)) / 1000 - TAI_OFFSET


def tai_millisecond(t: Column) -> Column:
    """Milliseconds within the minute."""
    return F.pmod(F.floor(t * 1000).cast("long"), F.lit(60000))


def unix_to_datenum(t: Column) -> Column:
    return t / 86400 + DATENUM_OFFSET


def datenum_to_unix(d: Column) -> Column:
    return (d - DATENUM_OFFSET) * 86400


def taim_to_datenum(m: Column, shift_hours: float = 0.0) -> Column:
    return unix_to_datenum(taim_to_unix(m)) + shift_hours / 24


def datenum_to_taim(d: Column) -> Column:
    return unix_to_taim(datenum_to_unix(d))


def ole_to_unix(d: Column) -> Column:
    return d * 86400 - OLE_OFFSET


def tz_offset_hours(zone: Column, at: Column) -> Column:
    """Hours by which a time zone is ahead of UTC at a timestamp, to the minute."""
    return F.round((F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60) / 60


def pack_stamp(taim: Column, ms: Column) -> Column:
    """32 bits: milliseconds (16), minute of the day (11), day modulo 32 (5)."""
    day = F.floor(taim / 1440).cast("long")
    minute = F.pmod(taim, F.lit(1440)).cast("long")
    return F.shiftleft(F.pmod(day, F.lit(32)), 27) + F.shiftleft(minute, 16) + ms


def unpack_stamp(stamp: Column, near: Column) -> Column:
    """The packed time as struct (taim, ms), of the days with that number modulo 32 the one within 7 days of `near` (TAI minutes); null if none is."""
    ms = stamp.bitwiseAND(F.lit(0xFFFF))
    minute = F.shiftright(stamp, 16).bitwiseAND(F.lit(0x7FF))
    day = F.shiftright(stamp, 27).bitwiseAND(F.lit(31))
    today = F.floor(near / 1440).cast("long")
    off = F.pmod(day - F.pmod(today, F.lit(32)) + 16, F.lit(32)) - 16
    return F.when(F.abs(off) <= 7, F.struct(((today + off) * 1440 + minute).alias("taim"), ms.alias("ms")))


def date_code(date: Column) -> Column:
    """Two digits of the year and month * 100 + day in base 36."""
    return F.concat(F.date_format(date, "yy"), F.conv((F.month(date) * 100 + F.dayofmonth(date)).cast("string"), 10, 36))


def date_of_code(code: Column) -> Column:
    """The date of a date code (a leading D is ignored; years from 70 are of the last century) or of eight digits."""
    code = F.regexp_replace(code, "^[Dd]", "")
    md = F.conv(F.substring(code, 3, 10), 36, 10).cast("int")
    year = F.substring(code, 1, 2).cast("int")
    coded = F.make_date(year + F.when(year >= 70, 1900).otherwise(2000), F.floor(md / 100).cast("int"), md % 100)
    return F.when(code.rlike(r"^\d{8}$"), F.to_date(code, "yyyyMMdd")).otherwise(coded)


def duration_text(seconds: Column) -> Column:
    """"1d 2.0h", "1h 2.0m", "1m 2.0s" or "2.0s"."""
    whole = lambda unit: F.floor(seconds / unit).cast("long")
    rest = lambda unit, part: F.format_string("%.1f", (seconds - whole(unit) * unit) / float(part))
    text = lambda unit, part, a, b: F.concat(whole(unit).cast("string"), F.lit(a + " "), rest(unit, part), F.lit(b))
    return F.when(seconds >= 86400, text(86400, 3600, "d", "h")).when(seconds >= 3600, text(3600, 60, "h", "m")).when(seconds >= 60, text(60, 1, "m", "s")).otherwise(F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s")))


def byte_text(n: Column) -> Column:
    """A number of bytes in binary multiples, to three significant digits."""
    out = None
    for k in range(len(UNITS) - 1, -1, -1):
        v = n / float(1024**k)
        shown = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        shown = F.regexp_replace(shown, r"(\.\d*?)0+$", "$1")
        text = F.concat(F.regexp_replace(shown, r"\.$", ""), F.lit(" " + UNITS[k]))
        cond = n >= float(1024**k) if k else F.lit(True)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out
