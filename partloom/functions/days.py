"""Days and months: local time, list dates, compound inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours by which local time is behind UTC.
BEHIND = 3


def local_day(utc: Column) -> Column:
    """The local day of a UTC time."""
    return (utc - F.expr(f"INTERVAL {BEHIND} HOURS")).cast("date")


def utc_of(local: Column) -> Column:
    """The UTC time of a local one."""
    return local + F.expr(f"INTERVAL {BEHIND} HOURS")


def list_date(file: Column, loaded: Column) -> Column:
    """struct(day, origin): the first day (d m yy or yyyy) in a file's name that is a date, not after the day of loading and not
    over 730 days before it; otherwise the day of loading; null without one."""
    shape = r"(?<![0-9])([0-9]{1,2})[ ._-]([0-9]{1,2})[ ._-]([0-9]{4}|[0-9]{2})(?![0-9])"

    def day(x):
        d, m, y = (F.regexp_extract(x, shape, k).cast("int") for k in (1, 2, 3))
        return F.try_to_date(F.format_string("%04d-%02d-%02d", F.when(y < 100, y + 2000).otherwise(y), m, d), "yyyy-MM-dd")

    found = F.transform(F.regexp_extract_all(file, F.lit(shape), F.lit(0)), day)
    first = F.get(F.filter(found, lambda d: (d <= loaded) & (d >= F.date_sub(loaded, 730))), 0)
    return F.when(loaded.isNotNull(), F.struct(F.coalesce(first, loaded).alias("day"), F.when(first.isNotNull(), "list").otherwise("loaded").alias("origin")))


def inflation_since(rows: DataFrame, monthly: DataFrame, day: str) -> DataFrame:
    """rows with inflation, compounded over the whole months after that of the day: none after the last month published, all of
    them before the first; null without a day or without any month. monthly: month (yyyy-MM) and rate. Months are few, as many
    as the calendar has, so both sides of the first join and what comes of it are small."""
    if monthly.isEmpty():
        return rows.withColumn("inflation", F.lit(None).cast("double"))
    at = rows.withColumn("month", F.date_format(day, "yyyy-MM"))
    asked = at.select("month").where("month is not null").distinct()
    later = asked.join(monthly.select(F.col("month").alias("later"), "rate"), F.col("later") > F.col("month"), "left")
    total = later.groupBy("month").agg((F.exp(F.coalesce(F.sum(F.log1p("rate")), F.lit(0.0))) - 1).alias("inflation"))
    return at.join(total, "month", "left").drop("month")
