"""Trading calendar."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Month-day of the holidays observed every year.
HOLIDAYS = ["01-01", "07-04", "12-25"]


def trading_calendar(span: DataFrame, holidays: list[str]) -> DataFrame:
    """Weekdays between the dates `first` and `last` of a one-row frame, without holidays."""
    days = span.select(F.explode(F.sequence("first", "last")).alias("day")).where(F.weekday("day") < 5)
    closed = span.sparkSession.createDataFrame([(h,) for h in holidays], "month_day string")
    return (days.withColumn("month_day", F.date_format("day", "MM-dd"))
            .join(closed, "month_day", "left_anti").select("day"))
