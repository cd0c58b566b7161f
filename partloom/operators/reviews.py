"""Review of pending links: queues, what decisions teach, errors found later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import by_rows, staged

def by_origin(links: DataFrame, solid: int = 70) -> DataFrame:
    """Per origin: links, share of solid ones, verified ones. links: origin, conf, verified."""
    return links.groupBy("origin").agg(F.count("*").alias("links"), F.round(F.count_if(F.col("conf") >= solid) / F.count("*"), 6).alias("solid"), F.count_if("verified").alias("verified"))


def waiting(pending: DataFrame, products: DataFrame) -> DataFrame:
    """Per brand: products with pending links."""
    ends = pending.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.join(products, "id").groupBy("brand").agg(F.count("*").alias("products"))


def board(decisions: DataFrame, least: int = 30) -> DataFrame:
    """Share of approved decisions by family, and by pair of lists; groups of `least` or more. decisions: family, brand_a, brand_b, approved."""
    d = decisions.select("family", F.least("brand_a", "brand_b").alias("brand"), F.greatest("brand_a", "brand_b").alias("other"), "approved")
    g = d.groupingSets([["family"], ["brand", "other"]], "family", "brand", "other").agg(F.count("*").alias("decisions"), F.round(F.count_if("approved") / F.count("*"), 6).alias("rate"))
    return g.where(F.col("decisions") >= least)


def accuracy(decisions: DataFrame) -> DataFrame:
    """How often decisions agreed with the score, by band, by signal, and in all. decisions: band, signal, agreed."""
    g = decisions.groupingSets([["band"], ["signal"], []], "band", "signal")
    return g.agg(F.count("*").alias("decisions"), F.round(F.count_if("agreed") / F.count("*"), 6).alias("agreed"))


def by_alarm(decisions: DataFrame, least: int = 5) -> DataFrame:
    """Share of approved decisions among those that carried each alarm. decisions: alarms (array), approved."""
    g = decisions.select(F.explode(F.array_distinct("alarms")).alias("alarm"), "approved").groupBy("alarm").agg(F.count("*").alias("decisions"), F.round(F.count_if("approved") / F.count("*"), 6).alias("rate"))
    return g.where(F.col("decisions") >= least)


def practice(decisions: DataFrame, each: int = 10, seed: str = "1") -> DataFrame:
    """Cases to practise on: half rejected, half approved, in the order of a seeded hash. decisions: id, approved."""
    w = Window.partitionBy("approved").orderBy(F.md5(F.concat(F.lit(seed), F.lit("/"), F.col("id").cast("string"))), "id")
    return decisions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each // 2).select("id", "approved", "place")


def groups(pairs: DataFrame) -> DataFrame:
    """Clean pairs by pair of lists and band. pairs: brand_a, brand_b, band."""
    return pairs.groupBy(F.least("brand_a", "brand_b").alias("brand"), F.greatest("brand_a", "brand_b").alias("other"), "band").agg(F.count("*").alias("pairs"))


def fans(pairs: DataFrame) -> DataFrame:
    """Products with several candidates in one other list, whose codes are not all sizes of one part. pairs: a, list, base."""
    rows = by_rows(staged(pairs.select("a", "list", "base"), "fans"), "a")
    return rows.groupBy("a", "list").agg(F.count_distinct("base").alias("options"), F.count("*").alias("candidates")).where("options > 1")


def fan_options(pairs: DataFrame) -> DataFrame:
    """The options of a fan: candidates with one base code stand as one. pairs: a, list, base, b."""
    return pairs.groupBy("a", "list", "base").agg(F.min("b").alias("b"), F.count("*").alias("variants"))


def sold_then_rejected(sales: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sales of a pair that was rejected after. sales: sale_id, a, b, seen; rejected: a, b, at."""
    pair = lambda df: df.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).drop("a", "b")
    first = pair(rejected).groupBy("x", "y").agg(F.max("at").alias("at"))
    return pair(sales).join(first, ["x", "y"]).where("at > seen").select("sale_id", F.col("x").alias("a"), F.col("y").alias("b"))


def drift_flag(moves: DataFrame, least: int = 100, up: float = 0.05, any_way: float = 0.3) -> DataFrame:
    """One row: links, those whose band rose and fell, and the flag: `large` if over any_way of `least` links or more moved,
    `lax` if as many rose as `least` and over the share `up`, else null. moves: old and new rank of the band."""
    g = moves.agg(F.count("*").alias("links"), F.count_if(F.col("new") > F.col("old")).alias("rose"), F.count_if(F.col("new") < F.col("old")).alias("fell"))
    moved = F.col("rose") + F.col("fell")
    flag = F.when((F.col("links") >= least) & (moved > any_way * F.col("links")), "large").when((F.col("rose") >= least) & (F.col("rose") > up * F.col("links")), "lax")
    return g.withColumn("flag", flag)
