"""Vehicles: plates, service history, what is due and whom to tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters_rank(c: Column, n: int) -> Column:
    """The place of n capital letters in alphabetical order, as a number to base 26."""
    return sum(((F.ascii(F.substring(c, k + 1, 1)) - 65) * 26 ** (n - 1 - k) for k in range(n)), F.lit(0)).cast("long")


def year_by_anchors(rank: Column, anchors: list[tuple[int, int]]) -> Column:
    """struct(year, extrapolated) between known (rank, year): straight lines between neighbours, the end years beyond them.
    anchors are a fixed, short list in order."""
    out = F.struct(F.lit(anchors[-1][1]).cast("long").alias("year"), (rank > anchors[-1][0]).alias("extrapolated"))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(rank <= x1, F.struct(F.rint(y0 + (y1 - y0) * (rank - x0) / (x1 - x0)).cast("long").alias("year"), F.lit(False).alias("extrapolated"))).otherwise(out)
    return F.when(rank <= anchors[0][0], F.struct(F.lit(anchors[0][1]).cast("long").alias("year"), (rank < anchors[0][0]).alias("extrapolated"))).otherwise(out)


def latest(rows: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The last `most` rows of each key, with place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def part_states(history: DataFrame, vehicles: DataFrame, today: str, warn_days: int = 30, warn_km: int = 1000) -> DataFrame:
    """Each part of each vehicle by its last change: kilometres and days left, and state. history: vehicle, part, seen, km,
    life_km, life_days; vehicles: vehicle, km_now. The last change is that of most kilometres, then of the last day; one without
    kilometres is later if its day is. A life that it does not note (null or not above zero) is that of the change before which does."""
    row = lambda *first: F.struct(*first, F.coalesce("life_km", F.lit(-1)).alias("k"), F.coalesce("life_days", F.lit(-1)).alias("d"))
    order = F.struct(F.col("km").isNotNull().alias("has"), "km", "seen", F.coalesce("life_km", F.lit(-1)).alias("k"), F.coalesce("life_days", F.lit(-1)).alias("d"))
    noted = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, order)).alias(f"last_{c}")
    g = history.groupBy("vehicle", "part").agg(F.max(F.when(F.col("km").isNotNull(), row("km", "seen"))).alias("x"), F.max(F.when(F.col("km").isNull(), row("seen"))).alias("y"), noted("life_km"), noted("life_days"))
    later = F.col("x").isNull() | (F.col("y.seen") > F.col("x.seen"))
    pick = lambda c: F.when(F.coalesce(later, F.lit(False)), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))
    life = lambda c, k: F.when(pick(k) > 0, pick(k)).otherwise(F.col(f"last_{c}"))
    at = F.when(~F.coalesce(later, F.lit(False)), F.col("x.km"))
    rows = g.join(vehicles, "vehicle").select("vehicle", "part", at.alias("km"), pick("seen").alias("seen"), life("life_km", "k").alias("life_km"), life("life_days", "d").alias("life_days"), "km_now")
    km = F.col("km") + F.col("life_km") - F.col("km_now")
    days = F.date_diff(F.date_add("seen", F.col("life_days").cast("int")), F.lit(today).cast("date"))
    state = F.when((km < 0) | (days < 0), "overdue").when((km <= warn_km) | (days <= warn_days), "soon").otherwise("fine")
    return rows.select("vehicle", "part", km.alias("km_left"), days.alias("days_left"), state.alias("state"))


def most_urgent(states: DataFrame, km_a_day: float = 40.0) -> DataFrame:
    """Per vehicle with parts overdue or due soon: how many, the days until the first is due by either measure, and that part."""
    due = states.where("state <> 'fine'").withColumn("days", F.least(F.floor(F.col("km_left") / km_a_day), F.col("days_left")))
    return due.groupBy("vehicle").agg(F.count("*").alias("parts"), F.min(F.struct("days", "part")).alias("x")).select("vehicle", "parts", F.col("x.days").alias("days"), F.col("x.part").alias("part"))


def reminders(due: DataFrame, sent: DataFrame, today: str, apart: int = 15) -> DataFrame:
    """Vehicles that are due and have not been told within the last days. sent: vehicle, at."""
    recent = sent.where(F.col("at") > F.date_sub(F.lit(today).cast("date"), apart)).select("vehicle")
    return due.join(recent, "vehicle", "left_anti")


def changes_due(history: DataFrame, km: DataFrame) -> DataFrame:
    """Per vehicle and part: how often it should have been changed by now, by its mean life, less how often it was; none below
    zero. history: vehicle, part, life_km; km: vehicle, km_now."""
    g = history.groupBy("vehicle", F.upper("part").alias("part")).agg(F.count("*").alias("times"), F.avg("life_km").alias("life"))
    return g.join(km, "vehicle").where("life > 0").select("vehicle", "part", "times", F.greatest(F.floor(F.col("km_now") / F.col("life")) - F.col("times"), F.lit(0)).alias("due"))


def life_before(asked: DataFrame, history: DataFrame) -> DataFrame:
    """The last noted life of a part: of this vehicle first, of any other else. asked: vehicle, part."""
    noted = history.where("life_km is not null")
    own = latest(noted, ["vehicle", "part"], 1, F.desc("seen"), F.desc("life_km")).select("vehicle", "part", F.col("life_km").alias("own"))
    other = latest(noted, ["part"], 1, F.desc("seen"), F.desc("life_km")).select("part", F.col("life_km").alias("other"))
    return asked.join(own, ["vehicle", "part"], "left").join(other, "part", "left").select("vehicle", "part", F.coalesce("own", "other").alias("life_km"), F.col("own").isNotNull().alias("of_this_one"))
