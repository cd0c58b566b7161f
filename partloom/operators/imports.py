"""What an import changes: products, prices, links; decisions on pending pairs; merges. All as set operations that
return the new tables, for a sink to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import by_rows, staged
from partloom.operators.pricing import jump


def outcomes(catalogue: DataFrame, incoming: DataFrame, most: float = 3.0) -> DataFrame:
    """Each incoming row (code, brand, price, stock) with what it does: `new`, `same`, `price`, `held` (a jump: the old
    price stays, the stock moves) or `no code`. Of rows with one key the last in the list counts."""
    last = F.row_number().over(Window.partitionBy("code", "brand").orderBy(F.desc("row_no")))
    rows = incoming.withColumn("n", last).where("n = 1").drop("n")
    old = catalogue.select("code", "brand", F.col("price").alias("old_price"), F.col("stock").alias("old_stock"), F.lit(True).alias("known"))
    joined = rows.join(old, ["code", "brand"], "left")
    why = jump(F.col("old_price"), F.col("price"), most)
    what = (
        F.when(F.coalesce("code", F.lit("")) == "", "no code").when(F.col("known").isNull(), "new").when(why.isNotNull(), "held")
        .when(F.col("price").isNotNull() & ~F.col("price").eqNullSafe(F.col("old_price")), "price").otherwise("same")
    )
    return joined.withColumn("outcome", what).drop("known")


def merged_catalogue(catalogue: DataFrame, result: DataFrame) -> DataFrame:
    """The catalogue after an import: held prices stay, stocks move, new rows come in."""
    rows = result.where("outcome <> 'no code'").select("code", "brand", F.when(F.col("outcome") == "held", F.col("old_price")).otherwise(F.coalesce("price", "old_price")).alias("price"), F.coalesce("stock", "old_stock").alias("stock"))
    return catalogue.select("code", "brand", "price", "stock").join(rows.select("code", "brand"), ["code", "brand"], "left_anti").unionByName(rows)


def queue(pending: DataFrame, candidates: DataFrame, links: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidate pairs that are neither linked, nor pending, nor rejected, in canonical order and once. All: a, b."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    out = pair(candidates)
    for other in (pending, links, rejected):
        out = out.join(pair(other), ["a", "b"], "left_anti")
    return out


def approve(pending: DataFrame, rejected: DataFrame, safety: DataFrame, joins: DataFrame, most_new: int = 100) -> DataFrame:
    """Pending pairs that may be approved in bulk: not rejected, without a safety part, and not joining large networks.
    safety: id; joins: a, b, new_pairs."""
    safe = pending.join(rejected.select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        safe = safe.join(safety.select(F.col("id").alias(side)), side, "left_anti")
    return safe.join(joins.where(F.col("new_pairs") >= most_new).select("a", "b"), ["a", "b"], "left_anti")


def merge_products(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links after products are merged into others: both ends re-pointed, self-links gone, best confidence kept. aliases: loser, winner."""
    out = links
    for side in ("a", "b"):
        out = out.join(aliases.select(F.col("loser").alias(side), F.col("winner").alias("w")), side, "left").withColumn(side, F.coalesce("w", side)).drop("w")
    return out.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("conf").alias("conf"))


def no_longer_declared(before: DataFrame, now: DataFrame, listed: DataFrame) -> DataFrame:
    """Links of the last list that this one does not declare, though it has both products. before, now: a, b; listed: id."""
    gone = before.join(now.select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        gone = gone.join(listed.select(F.col("id").alias(side)), side, "left_semi")
    return gone


def replacement_ends(replacements: DataFrame, most: int = 10) -> DataFrame:
    """Where each replaced code's chain ends: code, last, steps. Each step takes the newest row; a chain stops at a code
    seen before or after `most` steps. replacements: old, new, seen."""
    newest = by_rows(replacements.select("old", "new", "seen"), "old").groupBy("old").agg(F.max_by("new", F.struct("seen", "new")).alias("new"))
    newest = staged(newest, "newest")
    # A chain goes on only at a code that is new somewhere and old elsewhere; where these are few, each step is a broadcast.
    nxt = staged(newest.join(newest.select(F.col("new").alias("old")).distinct(), "old", "left_semi"), "steps").toDF("o", "n")
    state = newest.select(F.col("old").alias("code"), F.col("new").alias("last"), F.lit(1).alias("steps"), F.array("old", "new").alias("path"))
    for _ in range(most - 1):
        go = F.col("n").isNotNull() & ~F.array_contains("path", F.coalesce("n", F.lit("")))
        state = state.join(nxt, state.last == nxt.o, "left").select(
            "code", F.when(go, F.col("n")).otherwise(F.col("last")).alias("last"), (F.col("steps") + go.cast("int")).alias("steps"), F.when(go, F.concat("path", F.array("n"))).otherwise(F.col("path")).alias("path"),
        )
    return state.select("code", "last", "steps")


def free_stock(stock: DataFrame, reservations: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Stock less what is reserved and not expired, never below zero. stock: id, stock; reservations: id, units, seen."""
    live = reservations.where(F.col("seen") >= F.date_sub(F.lit(now).cast("date"), days)).groupBy("id").agg(F.sum("units").alias("held"))
    return stock.join(live, "id", "left").select("id", "stock", F.greatest(F.col("stock") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("free"))
