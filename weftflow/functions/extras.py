"""Columns for operating hours, run times and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days as Spark numbers them, Sunday first.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
RUNS = 10


def in_hours(ts: Column, days: dict[str, tuple[int, int]], zone: str = "UTC") -> Column:
    """Whether a UTC timestamp lies within its weekday's window (start and end in minutes of the day, end without) in a time zone."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.lit(False)
    for day, (start, end) in days.items():
        out = out | ((F.dayofweek(local) == DAYS.index(day) + 1) & (minute >= start) & (minute < end))
    return F.coalesce(out, F.lit(False))


def next_opening(ts: Column, days: dict[str, tuple[int, int]], zone: str = "UTC") -> Column:
    """The start, in the zone's local time, of the next window within 14 days that hasn't begun; null without one."""
    local = F.from_utc_timestamp(ts, zone)
    starts = F.create_map(*(F.lit(x) for d, (start, _) in days.items() for x in (DAYS.index(d) + 1, start))) if days else None
    if starts is None:
        return F.lit(None).cast("timestamp")

    def opening(i: Column) -> Column:
        day = F.date_add(F.to_date(local), i)
        return F.timestamp_add("MINUTE", starts[F.dayofweek(day)], day.cast("timestamp"))

    return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(14)), opening), lambda t: t >= local))


def expected_seconds(runs: DataFrame, by: str = "pipeline", started: str = "started_at", seconds: str = "seconds", last: int = RUNS) -> DataFrame:
    """(by, expected_seconds): the mean over each one's last runs."""
    w = Window.partitionBy(by).orderBy(F.desc(started))
    return runs.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= last).groupBy(by).agg(F.avg(seconds).alias("expected_seconds"))


def sealed(value: Column, passphrase: Column) -> Column:
    """Base64 of the value under AES-256-GCM, the key being the passphrase's SHA-256."""
    return F.base64(F.aes_encrypt(value, F.unhex(F.sha2(passphrase, 256)), F.lit("GCM")))


def opened(value: Column, passphrase: Column) -> Column:
    """What `sealed` took; null where the passphrase is another one."""
    return F.try_aes_decrypt(F.unbase64(value), F.unhex(F.sha2(passphrase, 256)), F.lit("GCM")).cast("string")
