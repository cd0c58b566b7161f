"""Sales, stock and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def money(c, digits: int = 2):
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + 0.0


def abc(sales: DataFrame, searches: DataFrame, today: str, days: int = 180, top: int = 300) -> DataFrame:
    """Parts sold or searched in the last days, by sales and then searches: the first fifth is A, up to half B, the rest C."""
    since = F.date_sub(F.lit(today).cast("date"), days)
    sold = sales.where((F.col("seen") >= since) & ~F.col("returned")).groupBy("part").agg(F.count("*").alias("sold"))
    rows = sold.join(searches, "part", "full").select("part", F.coalesce("sold", F.lit(0)).alias("sold"), F.coalesce("searched", F.lit(0)).alias("searched"))
    kept = rows.orderBy(F.desc("sold"), F.desc("searched"), "part").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("sold"), F.desc("searched"), "part")) - 1  # at most `top` rows
    n = F.count("*").over(Window.partitionBy())
    kept = kept.select("part", "sold", "searched", place.alias("place"), n.alias("n"))
    cls = F.when(F.col("place") < F.greatest(F.lit(1.0), F.round(0.2 * F.col("n"))), "A").when(F.col("place") < F.round(0.5 * F.col("n")), "B").otherwise("C")
    return kept.select("part", "sold", "searched", cls.alias("class"))


def dead_stock(products: DataFrame, sales: DataFrame, today: str, days: int = 180) -> DataFrame:
    """Products without a sale that stood in the last days, with the last such sale (null: never)."""
    last = sales.where(~F.col("returned")).groupBy("id").agg(F.max("seen").alias("last_sale"))
    rows = products.join(last, "id", "left").where(F.col("last_sale").isNull() | (F.col("last_sale") < F.date_sub(F.lit(today).cast("date"), days)))
    return rows.select("id", F.date_format("last_sale", "yyyy-MM-dd").alias("last_sale"))


def stock_out(stock: DataFrame, sales: DataFrame, today: str, days: int = 180, least_sales: int = 3, warn_days: int = 21) -> DataFrame:
    """Parts whose stock ends within warn_days at the rate of the last days. stock: part, stock."""
    sold = sales.where((F.col("seen") >= F.date_sub(F.lit(today).cast("date"), days)) & ~F.col("returned")).groupBy("part").agg(F.count("*").alias("sales"), F.sum("units").alias("units"))
    left = F.col("stock") / (F.col("units") / days)
    return stock.join(sold.where(F.col("sales") >= least_sales), "part").select("part", "stock", "sales", money(left).alias("days_left")).where(F.col("days_left") <= warn_days)


def cover(stock: DataFrame, sales: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Days that the stock lasts at the rate of the last days; null for parts without sales."""
    sold = sales.where((F.col("seen") >= F.date_sub(F.lit(today).cast("date"), days)) & ~F.col("returned")).groupBy("part").agg(F.sum("units").alias("units"))
    return stock.join(sold, "part", "left").select("part", "stock", money(F.col("stock") * days / F.col("units")).alias("days_of_cover"))


def daily(sales: DataFrame, first: str, last: str) -> DataFrame:
    """Money by day net of returns, with a row for every day of the calendar."""
    spark = sales.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    sums = sales.groupBy(F.to_date("seen").alias("day")).agg(F.sum(F.when(F.col("returned"), 0.0).otherwise(F.col("money"))).alias("m"), F.count_if(~F.col("returned")).alias("items"))
    return calendar.join(sums, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), money(F.coalesce("m", F.lit(0.0))).alias("money"), F.coalesce("items", F.lit(0)).alias("items"))


def best_sellers(sales: DataFrame, top: int = 10) -> DataFrame:
    g = sales.where(~F.col("returned")).groupBy("part").agg(F.sum("units").alias("units"), money(F.sum("money")).alias("money"))
    return g.orderBy(F.desc("units"), F.desc("money"), "part").limit(top)


def brand_margin(sales: DataFrame) -> DataFrame:
    """Per brand: units, money and profit net of returns, and the margin in percent."""
    g = sales.where(~F.col("returned")).groupBy("brand").agg(F.sum("units").alias("units"), F.sum("money").alias("m"), F.sum("cost").alias("c"))
    return g.select("brand", "units", money("m").alias("money"), money(F.col("m") - F.col("c")).alias("profit"), money((F.col("m") - F.col("c")) / F.col("m") * 100).alias("margin_pct"))


def ledger(orders: DataFrame) -> DataFrame:
    """account, move, seen, due, amount, void: an order is a charge due in 30 days; finished ones are paid in full
    60 days later; pending ones are void."""
    charge = orders.select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") * 2).alias("move"), F.col("o_orderdate").alias("seen"), F.date_add(F.to_date("o_orderdate"), 30).alias("due"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "P").alias("void"))
    paid = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") * 2 + 1).alias("move"), F.date_add(F.to_date("o_orderdate"), 60).cast("timestamp_ntz").alias("seen"), F.lit(None).cast("date").alias("due"), (-F.col("o_totalprice")).alias("amount"), F.lit(False).alias("void"))
    return charge.unionByName(paid)


def running_balance(moves: DataFrame) -> DataFrame:
    """Balance after each move in the order of moves; void ones add nothing."""
    w = Window.partitionBy("account").orderBy("seen", "move").rowsBetween(Window.unboundedPreceding, 0)
    return moves.select("account", "move", money(F.sum(F.when(F.col("void"), 0.0).otherwise(F.col("amount"))).over(w)).alias("balance"))


def fifo_interest(moves: DataFrame, rate_pct: float, today: str) -> DataFrame:
    """All payments of an account are allotted to its charges by due date; what is unpaid and overdue bears simple interest."""
    live = moves.where(~F.col("void"))
    paid = live.where("amount < 0").groupBy("account").agg((-F.sum("amount")).alias("paid"))
    w = Window.partitionBy("account").orderBy("due", "move").rowsBetween(Window.unboundedPreceding, 0)
    charges = live.where("amount > 0").select("account", "move", "due", "amount", F.sum("amount").over(w).alias("upto"))
    rows = charges.join(paid, "account", "left")
    unpaid = F.greatest(F.lit(0.0), F.least(F.col("amount"), F.col("upto") - F.coalesce("paid", F.lit(0.0))))
    days = F.date_diff(F.lit(today).cast("date"), F.col("due"))
    out = rows.select("account", "move", F.round(unpaid, 4).alias("unpaid"), days.alias("days")).where("unpaid > 0 and days > 0")
    return out.select("account", "move", money("unpaid").alias("unpaid"), "days", money(F.col("unpaid") * rate_pct / 100 * F.col("days") / 365).alias("interest"))


def account_state(moves: DataFrame, customers: DataFrame, today: str) -> DataFrame:
    """Per account: balance, overdue (at most the balance, at least 0) and credit left. customers: account, credit."""
    day = F.lit(today).cast("date")
    live = moves.where(~F.col("void"))
    g = live.groupBy("account").agg(F.sum("amount").alias("b"), F.sum(F.when((F.col("amount") > 0) & (F.col("due") >= day), F.col("amount")).otherwise(0.0)).alias("later"))
    rows = customers.join(g, "account", "left")
    b, later = F.coalesce("b", F.lit(0.0)), F.coalesce("later", F.lit(0.0))
    return rows.select("account", money(b).alias("balance"), money(F.greatest(F.lit(0.0), F.least(b, b - later))).alias("overdue"), money(F.col("credit") - b).alias("credit_left"))


def discontinued(prices: DataFrame, lists_in_a_row: int = 2) -> DataFrame:
    """Products absent from their brand's last lists: a list is a month in which the brand has prices; the cut is the
    Nth newest of a brand that has as many."""
    lists = prices.select("brand", F.date_format("seen", "yyyy-MM").alias("list")).distinct()
    place = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("list")))
    cut = lists.withColumn("place", place).where(F.col("place") == lists_in_a_row).select("brand", F.col("list").alias("cut"))
    last = prices.groupBy("id", "brand").agg(F.date_format(F.max("seen"), "yyyy-MM").alias("last_list"))
    return last.join(cut, "brand").where(F.col("last_list") < F.col("cut")).select("id", "brand", "last_list")


def closing(sales: DataFrame) -> DataFrame:
    """Per day: money sold, money returned and sales, as a till is closed."""
    return sales.groupBy(F.date_format("seen", "yyyy-MM-dd").alias("day")).agg(
        money(F.sum("money")).alias("sold"), money(F.sum(F.when(F.col("returned"), F.col("money")).otherwise(0.0))).alias("given_back"), F.count_distinct("sale_id").alias("sales"),
    )


def returns_by_brand(sales: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Returns of the last days against the days before; red from two returns and more than before."""
    day = F.lit(today).cast("date")
    now = (F.col("seen") >= F.date_sub(day, days)) & (F.col("seen") < day)
    before = (F.col("seen") >= F.date_sub(day, 2 * days)) & (F.col("seen") < F.date_sub(day, days))
    g = sales.where("returned").groupBy("brand").agg(F.count_if(now).alias("now"), F.count_if(before).alias("before"))
    return g.select("brand", "now", "before", ((F.col("now") >= 2) & (F.col("now") > F.col("before"))).alias("red"))


def free_stock(stock: DataFrame, reserved: DataFrame) -> DataFrame:
    """part, stock, reserved, free: what is left of each part's stock after active reservations, never under zero."""
    held = reserved.groupBy("part").agg(F.sum("units").alias("reserved"))
    rows = stock.join(held, "part", "left").withColumn("reserved", F.coalesce("reserved", F.lit(0.0)))
    return rows.select("part", "stock", "reserved", F.greatest(F.col("stock") - F.col("reserved"), F.lit(0.0)).alias("free"))
