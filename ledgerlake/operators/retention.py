"""Which backup sets stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_backups(sets: DataFrame, today: Column, all_days: int = 14, daily_days: int = 365) -> DataFrame:
    """``sets(set_id, created_at)`` that stay, with ``kept``: all for ``all_days``, then each day's newest for ``daily_days``, then each month's newest."""
    day, row = F.to_date("created_at"), F.struct(*sets.columns)
    age = lambda c: F.datediff(today, c)
    # One row a day, then a window over days: no task holds a day's or a month's sets.
    days = sets.groupBy(day.alias("__day")).agg(F.max_by(row, F.struct("created_at", "set_id")).alias("__row"))
    of_month = Window.partitionBy(F.trunc("__day", "MM")).orderBy(F.desc("__day"))
    days = days.withColumns({"__m": F.row_number().over(of_month), "__age": age(F.col("__day"))})
    older = days.where((F.col("__age") >= all_days) | F.col("__age").isNull())
    kept = F.when(F.col("__age") < daily_days, "daily").when(F.col("__m") == 1, "monthly")
    older = older.withColumn("kept", kept).where("kept is not null").select("__row.*", "kept")
    return sets.where(age(day) < all_days).withColumn("kept", F.lit("recent")).unionByName(older)
