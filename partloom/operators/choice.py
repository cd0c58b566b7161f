"""Which of several equivalents to offer: order, recommendation, margin, prices that do not follow the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import staged

#: Verdicts in the order in which they are offered.
VERDICTS = ("verified", "probable", "candidate", "contradicted", "rejected")
SOLID = 70


def verdict_rank(c: Column) -> Column:
    out = F.lit(len(VERDICTS) + 2)
    for k, name in reversed(list(enumerate(VERDICTS))):
        out = F.when(c == name, k).otherwise(out)
    return out


def chain_state(steps: DataFrame) -> DataFrame:
    """Per chain (key): candidate if a step has no primary source, verified if it is one solid step, else probable; and how
    many steps are weak. steps: chain, primary, verified, conf."""
    weak = F.count_if(~F.col("verified") & (F.col("conf") < SOLID))
    g = steps.groupBy("chain").agg(F.count("*").alias("steps"), F.count_if(~F.col("primary")).alias("unsourced"), weak.alias("weak"))
    state = F.when(F.col("unsourced") > 0, "candidate").when((F.col("steps") > 1) | (F.col("weak") > 0), "probable").otherwise("verified")
    return g.select("chain", "steps", "weak", state.alias("state"))


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with place: what was searched first, then by verdict, grade, stock and price (none last), within each key. rows:
    id, verdict, searched, grade (how far a plug's heat is from what was asked; 0 if it does not matter), stock, price."""
    w = Window.partitionBy(key).orderBy(
        (~F.col("searched")).cast("int"), F.when(F.col("searched"), 0).otherwise(verdict_rank(F.col("verdict"))), F.when(F.col("searched"), 0).otherwise(F.col("grade")),
        F.when(F.col("searched"), 0).otherwise((F.coalesce("stock", F.lit(0)) <= 0).cast("int")), F.when(F.col("searched"), 0.0).otherwise(F.coalesce(F.nullif("price", F.lit(0.0)), F.lit(float("inf")))), "id",
    )
    return rows.withColumn("place", F.row_number().over(w))


def barred() -> Column:
    """Why a row is not to be recommended; null if it may be. What came back or was rejected never is; what was searched always
    is else; the others must be verified, or probable and no part of safety. rows: verdict, searched, returned, refused, safety."""
    return (
        F.when(F.col("returned"), "returned").when(F.col("refused"), "refused").when(F.col("searched"), F.lit(None).cast("string"))
        .when(~F.col("verdict").isin("verified", "probable"), F.col("verdict")).when(F.col("safety") & (F.col("verdict") != "verified"), "safety")
    )


def recommended(rows: DataFrame, key: str) -> DataFrame:
    """Per key with anything in stock that has a price: the cheapest of what may be recommended (of the nearest grade first), the
    cheapest of all, and why that one is not recommended if it is cheaper: what bars it, or `grade`. Sets, and brands whose list
    has another scale, do not compete. rows: id, verdict, searched, returned, refused, safety, kit, off_scale, grade, stock, price."""
    priced = rows.where("stock > 0 and price > 0 and not kit and not off_scale").withColumn("bar", barred())
    best, cheap = F.struct("grade", F.col("price").alias("p"), F.col("id").alias("i")), F.struct(F.col("price").alias("p"), F.col("id").alias("i"), F.coalesce("bar", F.lit("grade")).alias("bar"))
    g = priced.groupBy(key).agg(F.min(F.when(F.col("bar").isNull(), best)).alias("a"), F.min(cheap).alias("b"))
    return g.select(key, F.col("a.i").alias("recommended"), F.col("b.i").alias("cheapest"), F.when(F.col("a").isNull() | (F.col("b.p") < F.col("a.p")), F.col("b.bar")).alias("why_not"))


def best_margin(rows: DataFrame, key: str) -> DataFrame:
    """Per key with two or more rows in stock that have price and cost and may be recommended: the one that leaves most, and by
    how much more than the one that leaves least. rows: as recommended() has them, and cost."""
    fine = rows.where("stock > 0 and price > 0 and cost > 0").withColumn("bar", barred()).where("bar is null").withColumn("gain", F.col("price") - F.col("cost"))
    g = fine.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("gain", F.negative("id").alias("i"))).alias("x"), F.min("gain").alias("least"))
    return g.where((F.col("n") > 1) & (F.col("x.gain") > F.col("least"))).select(key, F.negative("x.i").alias("id"), F.round("x.gain", 2).alias("gain"), F.round(F.col("x.gain") - F.col("least"), 2).alias("more"))


def against_size(rows: DataFrame, times: float = 3.0) -> DataFrame:
    """Sizes of one kind whose price lies `times` below or above both neighbouring sizes. The price of a size is the upper
    median of its rows. rows: brand, kind, size, price."""
    w = Window.partitionBy("brand", "kind", "size").orderBy("price")
    placed = rows.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("brand", "kind", "size"))})
    one = placed.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("brand", "kind", "size", "price")
    by = Window.partitionBy("brand", "kind").orderBy("size")
    near = one.withColumns({"before": F.lag("price").over(by), "after": F.lead("price").over(by)}).where("before is not null and after is not null")
    off = (F.col("price") * times < F.least("before", "after")) | (F.col("price") > times * F.greatest("before", "after"))
    return near.where(off).select("brand", "kind", "size", "price", "before", "after")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (prefix, n, kind, id) in order, each with rank: how many codes (kind 0) stand before it. Ranges of the order are
    counted first, so no window goes over all rows."""
    parts = staged(rows.repartitionByRange("prefix", "n", "kind", "id").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("range").agg(F.count_if(F.col("kind") == 0).alias("codes"))
    # One row for each range.
    before = sizes.select("range", F.coalesce(F.sum("codes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.count_if(F.col("kind") == 0).over(Window.partitionBy("range").orderBy("prefix", "n", "kind", "id").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("own", own).join(F.broadcast(before), "range").withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "range")


def _following(codes: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """prefix, asked, id, far: the first `most` codes of the prefix at or after what is asked. Columns: prefix, n, id; prefix, n."""
    rows = codes.select("prefix", "n", F.lit(0).alias("kind"), "id").unionByName(asked.select("prefix", "n", F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("id")))
    ranked = staged(_ranked(rows), "ranks")
    wanted = ranked.where("kind = -1").select("prefix", F.col("n").alias("asked"), F.explode(F.sequence(F.col("rank"), F.col("rank") + most - 1)).alias("rank"))
    return wanted.join(ranked.where("kind = 0").select("prefix", "n", "id", "rank"), ["prefix", "rank"]).select("prefix", "asked", "id", (F.col("n") - F.col("asked")).alias("far"))


def nearest_codes(codes: DataFrame, wanted: DataFrame, most: int = 8) -> DataFrame:
    """For each wanted prefix and number: the codes of the same prefix with the nearest numbers, an equal one too; of equals the
    least ids. Codes and what is asked are put in one order, and an asked number meets the codes of the ranks next to it, so no
    prefix is joined as a whole. codes: id, prefix, number; wanted: prefix, asked."""
    c, a = codes.select("prefix", F.col("number").cast("long").alias("n"), F.col("id").cast("long")), wanted.select("prefix", F.col("asked").cast("long").alias("n")).distinct()
    up = _following(c, a, most)
    down = _following(c.withColumn("n", -F.col("n")), a.withColumn("n", 1 - F.col("n")), most).select("prefix", (1 - F.col("asked")).alias("asked"), "id", (F.col("far") + 1).alias("far"))
    w = Window.partitionBy("prefix", "asked").orderBy("far", "id")
    return up.unionByName(down).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("prefix", "asked", "place", "id", "far")
