"""Row predicates: bar validation and the regular trading session."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reject_reason() -> Column:
    """Why a bar is refused; 'ok' for a valid one."""
    return (F.when(F.col("high") < F.col("low"), "high_below_low")
            .when(~F.col("close").between(F.col("low"), F.col("high")), "close_outside")
            .when((F.col("open") <= 0) | (F.col("close") <= 0), "not_positive")
            .when(F.col("volume") < 0, "negative_volume").otherwise("ok"))


def accepted(bars: DataFrame) -> DataFrame:
    return bars.where(reject_reason() == "ok")


def quarantined(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reason", reject_reason()).where("reason <> 'ok'")


def in_regular_session(ts: str, zone: str = "America/New_York") -> Column:
    """Weekdays from 09:30 up to 16:00 local time, for timestamps stored in UTC."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & (minute >= 9 * 60 + 30) & (minute < 16 * 60)
