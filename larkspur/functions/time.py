"""Time Columns. ``now`` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def wall_clock(text: Column) -> Column:
    """ISO text as ``YYYY-MM-DD HH:MM:SS.mmm``; an offset is dropped, not applied; anything else stays."""
    t = F.trim(text)
    fraction = F.rpad(F.substring(F.regexp_extract(t, ISO, 3), 2, 3), 3, "0")
    made = F.concat(F.regexp_extract(t, ISO, 1), F.lit(" "), F.regexp_extract(t, ISO, 2), F.lit("."), fraction)
    return F.when(t.rlike(ISO), made).otherwise(text)


# The accepted forms of a timestamp.
FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "yyyy/MM/dd HH:mm:ss")


def normalise_timestamp(text: Column) -> Column:
    """several forms, a weekday in brackets among them, as ``YYYY-MM-DD HH:MM:SS``; null if none fits."""
    t = F.regexp_replace(F.trim(text), r"\s*\([^)]*\)\s*", " ")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMS]), "yyyy-MM-dd HH:mm:ss")


def beijing(ts: Column) -> Column:
    """a UTC timestamp as wall-clock text in Asia/Shanghai."""
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


def time_decay(ts: Column, now: Column, tau_days: float = 30.0) -> Column:
    """exp(-days / tau); 1 for the future, for null and for tau <= 0."""
    if tau_days <= 0:
        return F.lit(1.0)
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-F.greatest(F.lit(0.0), days) / F.lit(float(tau_days))), F.lit(1.0))
