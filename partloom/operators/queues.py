"""In which order to look at pending pairs, and makers' codes that join what does not belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.checks import is_kit
from partloom.functions.staging import staged
from partloom.functions.text import without_marks
from partloom.operators.graph import joined_by
from partloom.operators.search import classify

# New pairs from which a pending pair joins large networks; products that a real maker's code has at most, and
# families from which it mixes what does not belong together.
LARGE, CROWDED, MIXED = 100, 5, 3
#: The share approved that stands for alarms of which nothing is known.
UNKNOWN = 0.5


def bridges_of_lots(pending: DataFrame, nets: DataFrame, least: int = LARGE) -> DataFrame:
    """lot, a, b and new_pairs: pending pairs that would join large networks, to be looked at one by one. pending: lot, a, b; nets: id, net."""
    joins = joined_by(pending.select("a", "b").distinct(), nets).where(F.col("new_pairs") >= least).select("a", "b", "new_pairs")
    return pending.select("lot", "a", "b").distinct().join(joins, ["a", "b"]).select("lot", "a", "b", "new_pairs")


def review_order(pending: DataFrame, nets: DataFrame, rates: DataFrame, least: int = LARGE) -> DataFrame:
    """lot, a, b, batch and place: what joins large networks first, the most so first; then batches of like pairs (of two lists and
    one family), the largest first, and in each what with its alarms was approved most (its worst alarm decides), like alarms
    together, the surest first. pending: lot, a, b, brand_a, brand_b, family, alarms, conf; rates: alarm, rate. A lot is one list's
    pairs; its order is made over ranges of it."""
    pending = staged(pending, "pending")
    joins = joined_by(pending.select("a", "b").distinct(), nets).where(F.col("new_pairs") >= least).select("a", "b", "new_pairs")
    marked = pending.join(joins, ["a", "b"], "left")
    known = rates.groupBy("alarm").agg(F.min("rate").alias("rate")).agg(F.map_from_entries(F.collect_list(F.struct("alarm", "rate"))).alias("rates"))
    worst = F.array_min(F.transform("alarms", lambda x: F.element_at("rates", x)))
    rows = staged(marked.join(F.broadcast(known)).withColumn("worst", worst).drop("rates"), "marked")
    key = ["lot", "brand_a", "brand_b", "family"]
    sizes = rows.where("new_pairs is null").groupBy(*key).agg(F.count("*").alias("size"))
    named = F.concat_ws(" / ", F.col("brand_a").cast("string"), F.col("brand_b").cast("string"), F.coalesce("family", F.lit("?")))
    met = rows.alias("r").join(sizes.alias("s"), (F.col("r.lot") == F.col("s.lot")) & F.col("r.brand_a").eqNullSafe(F.col("s.brand_a")) & F.col("r.brand_b").eqNullSafe(F.col("s.brand_b")) & F.col("r.family").eqNullSafe(F.col("s.family")), "left").select("r.*", "s.size")
    order = [
        F.col("new_pairs").isNull(), F.desc("new_pairs"), F.desc(F.when(F.col("new_pairs").isNull(), F.col("size"))), F.when(F.col("new_pairs").isNull(), named), F.desc(F.when(F.col("new_pairs").isNull(), F.coalesce("worst", F.lit(UNKNOWN)))),
        F.when(F.col("new_pairs").isNull(), F.array_join(F.array_sort("alarms"), ",")), F.desc(F.when(F.col("new_pairs").isNull(), F.col("conf"))), "a", "b",
    ]
    batch = F.when(F.col("new_pairs").isNull(), named).otherwise("joins networks")
    return placed(met.withColumn("batch", batch), "lot", order).select("lot", "a", "b", "batch", "place")


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with place, from 1 in each group. All rows are sorted in ranges, so that no group needs one task: a place is that within a
    range's share of the group, and all that earlier ranges hold of it."""
    ranges = staged(rows.orderBy(group, *order).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "in_order")
    held = ranges.groupBy(group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), (before - F.col("_first") + 1).alias("_start"))
    met = ranges.join(F.broadcast(starts), (F.col("_range") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*rows.columns, (F.col("_row") + F.col("_start")).cast("int").alias("place"))


def family_of_one(text: Column, families: list[tuple[str, str]]) -> Column:
    """The family of a description; null for a set, which may hold several."""
    plain = F.upper(without_marks(text))
    return F.when(~is_kit(plain), classify(F.concat(F.lit(" "), plain), [(f" {k}", f) for k, f in families]))


def suspicious_bridges(products: DataFrame, links: DataFrame, families: list[tuple[str, str]], most: int = CROWDED, mixed: int = MIXED) -> DataFrame:
    """id, products, families, crowded and mixed: makers' codes that more than `most` products hang from, or (of those with `most` - 1
    or more) products of `mixed` families or more; of a real code they are few, and of one. What is not known, and sets, are no
    family of their own. products: id, oem, text; links: a, b."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung = both.join(products.where("oem").select(F.col("id").alias("a")), "a").join(products.select(F.col("id").alias("b"), family_of_one(F.col("text"), families).alias("family")), "b")
    g = hung.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("products"), F.array_sort(F.collect_set("family")).alias("families")).where(F.col("products") >= max(2, most - 1))
    return g.withColumns({"crowded": F.col("products") > most, "mixed": F.size("families") >= mixed}).where("crowded or mixed")
