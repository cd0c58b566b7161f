"""Prices: drift, increases, scales between lists, jumps, placeholders, incoherent pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import by_rows
from partloom.functions.text import upper_median


def latest(prices: DataFrame) -> DataFrame:
    """id, price, seen: each product's newest price; of several at one time, the highest."""
    return prices.groupBy("id").agg(F.max(F.struct("seen", "price")).alias("x")).select("id", F.col("x.price").alias("price"), F.col("x.seen").alias("seen"))


def drift(prices: DataFrame, least_changes: int = 20) -> DataFrame:
    """Per brand: how many usable price changes it has, and the upper median of their monthly rates. A change is
    usable if the prices differ and lie a day apart or more."""
    w = Window.partitionBy("id").orderBy("seen", "price")
    rows = prices.select("id", "brand", "price", "seen", F.lag("price").over(w).alias("before"), F.lag("seen").over(w).alias("since"))
    days = F.date_diff(F.col("seen"), F.col("since"))
    usable = rows.where((days >= 1) & (F.col("before") > 0) & (F.col("price") != F.col("before")))
    rate = F.pow(F.col("price") / F.col("before"), F.lit(30.0) / days) - 1
    grouped = usable.withColumn("r", F.round(rate, 9)).groupBy("brand").agg(F.count("*").alias("changes"), upper_median("r").alias("rate"))
    return grouped.where(F.col("changes") >= least_changes).select("brand", "changes", F.round("rate", 6).alias("monthly_rate"))


def increases(prices: DataFrame, today: str, months: int, least_products: int = 10) -> DataFrame:
    """Per brand: the median increase over the last months, in percent. Before: a product's last price at or before the
    period's start; now: its newest. Equal prices and ratios above 20 or below 0.05 do not count."""
    start = F.add_months(F.lit(today).cast("date"), -months)
    before = prices.where(F.col("seen") <= start).groupBy("id", "brand").agg(F.max(F.struct("seen", "price")).alias("x")).select("id", "brand", F.col("x.price").alias("before"))
    now = prices.where(F.col("seen") > start).groupBy("id").agg(F.max(F.struct("seen", "price")).alias("x")).select("id", F.col("x.price").alias("now"))
    ratio = F.col("now") / F.col("before")
    rows = before.join(now, "id").where((ratio != 1) & (ratio <= 20) & (ratio >= 0.05))
    return rows.groupBy("brand").agg(F.count("*").alias("products"), F.round((F.percentile(ratio, 0.5) - 1) * 100, 4).alias("increase_pct")).where(F.col("products") >= least_products)


def jump(old: Column, new: Column, most: float = 3.0) -> Column:
    """Why a new price is held back: `decimal` if it is the old one times or over 10, 100 or 1000 (to 2 %), `jump` if it
    is more than `most` times as much or as little; null if it is fine or there is no old price."""
    ratio = F.greatest(old, new) / F.least(old, new)
    shifted = F.lit(False)
    for k in (10, 100, 1000):
        shifted = shifted | (F.abs(ratio / k - 1) <= 0.02)
    return F.when((old > 0) & (new > 0), F.when(shifted, "decimal").when(ratio > most, "jump"))


def jumps(prices: DataFrame, most: float = 3.0) -> DataFrame:
    """Consecutive prices of a product whose change would be held back."""
    w = Window.partitionBy("id").orderBy("seen", "price")
    rows = prices.select("id", "seen", F.lag("price").over(w).alias("old"), F.col("price").alias("new"))
    return rows.select("id", "seen", "old", "new", jump(F.col("old"), F.col("new"), most).alias("reason")).where("reason is not null")


def placeholders(priced: DataFrame, least_times: int = 20, least_classes: int = 8, times_median: float = 20.0) -> DataFrame:
    """Prices that stand for none: repeated often, over many classes of part, and far above the list's median. priced:
    brand, class, price."""
    median = priced.groupBy("brand").agg(F.percentile("price", 0.5).alias("median"))
    often = priced.groupBy("brand", "price").agg(F.count("*").alias("times"), F.count_distinct("class").alias("classes")).where((F.col("times") >= least_times) & (F.col("classes") >= least_classes))
    return often.join(median, "brand").where(F.col("price") >= times_median * F.col("median")).select("brand", "price", "times", "classes")


def two_prices(prices: DataFrame, hours: int = 1) -> DataFrame:
    """Products that have two prices over 5 % apart within hours of their last row."""
    last = F.max("seen").over(Window.partitionBy("id"))
    near = by_rows(prices.select("id", "price", "seen"), "id").withColumn("last", last).where(F.col("seen") >= F.col("last") - F.make_dt_interval(hours=F.lit(hours)))
    g = near.groupBy("id").agg(F.count_distinct("price").alias("prices"), F.min("price").alias("lowest"), F.max("price").alias("highest"))
    return g.where((F.col("prices") >= 2) & (F.col("highest") > 1.05 * F.col("lowest"))).select("id", "prices", "lowest", "highest")


def linked_prices(links: DataFrame, priced: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """links with both products' brands and prices. brands: id, brand; none where priced has the brand."""
    of = priced.select("id", "price", "brand") if brands is None else priced.select("id", "price").join(brands.select("id", "brand"), "id")
    return links.join(of.toDF("a", "price_a", "brand_a"), "a").join(of.toDF("b", "price_b", "brand_b"), "b")


def brand_scale(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Per brand: the median of its price over its equivalents' prices."""
    way = lambda x, y: F.struct(F.col(f"brand_{x}").alias("brand"), (F.col(f"price_{x}") / F.col(f"price_{y}")).alias("ratio"))
    both = pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    return both.groupBy("brand").agg(F.count("*").alias("pairs"), F.round(F.percentile("ratio", 0.5), 6).alias("scale")).where(F.col("pairs") >= least)


def incoherent(pairs: DataFrame, scale: DataFrame, factor: float, top: int = 200) -> DataFrame:
    """The linked pairs whose prices, each over its brand's scale, lie `factor` apart or more; the top ones."""
    s = scale.select("brand", "scale")
    rows = pairs.join(s.toDF("brand_a", "s_a"), "brand_a", "left").join(s.toDF("brand_b", "s_b"), "brand_b", "left")
    x, y = F.col("price_a") / F.coalesce("s_a", F.lit(1.0)), F.col("price_b") / F.coalesce("s_b", F.lit(1.0))
    rows = rows.select("a", "b", F.round(F.greatest(x, y) / F.least(x, y), 4).alias("times")).where(F.col("times") >= factor)
    return rows.orderBy(F.desc("times"), "a", "b").limit(top)


def duels(pairs: DataFrame, least_conf: int = 50, most_ratio: float = 8.0, least: int = 5) -> DataFrame:
    """Brand against brand over linked products: comparisons, how often the first is cheaper, the upper median ratio."""
    first = F.col("brand_a") < F.col("brand_b")
    rows = pairs.where((F.col("conf") >= least_conf) & (F.col("brand_a") != F.col("brand_b"))).select(
        F.least("brand_a", "brand_b").alias("brand"), F.greatest("brand_a", "brand_b").alias("other"), F.when(first, F.col("price_a")).otherwise(F.col("price_b")).alias("p"), F.when(first, F.col("price_b")).otherwise(F.col("price_a")).alias("q"),
    )
    rows = rows.withColumn("ratio", F.col("p") / F.col("q")).where((F.col("ratio") < most_ratio) & (F.col("ratio") > 1 / most_ratio))
    g = rows.withColumn("r", F.round("ratio", 9)).groupBy("brand", "other").agg(F.count("*").alias("comparisons"), F.count_if(F.col("p") < F.col("q")).alias("wins"), upper_median("r").alias("r"))
    return g.where(F.col("comparisons") >= least).select("brand", "other", "comparisons", "wins", F.round("r", 6).alias("ratio"))


def before_change(prices: DataFrame) -> DataFrame:
    """id, price, last_other, last_other_seen: a product's newest price, and the last it had that was another one;
    products that never changed are left out."""
    now = latest(prices).select("id", F.col("price").alias("now"))
    other = prices.join(now, "id").where("price <> now").groupBy("id", "now").agg(F.max(F.struct("seen", "price")).alias("x"))
    return other.select("id", F.col("now").alias("price"), F.col("x.price").alias("last_other"), F.col("x.seen").alias("last_other_seen"))
