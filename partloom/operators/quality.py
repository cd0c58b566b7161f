"""Checks of a catalogue: dangling references, contradictions, completeness, lots out of line, samples."""

from __future__ import annotations

from bisect import insort
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.graph import both_ways


def dangling(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """name and rows: for each (name, child, key, parent, key) how many child rows have a key without a parent."""
    counts = [child.join(parent.select(F.col(pk).alias("_k")), F.col(ck) == F.col("_k"), "left_anti").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, child, ck, parent, pk in checks]
    return reduce(DataFrame.unionByName, counts)


def value_checks(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """name and rows: how many rows of each table fulfil a condition that none should."""
    counts = [df.agg(F.count_if(F.expr(bad)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df, bad in checks]
    return reduce(DataFrame.unionByName, counts)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def impossible_relations(links: DataFrame, pending: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counts of relations that contradict each other: self-links, linked yet rejected, pending yet rejected, mirrored.
    Each input has a, b; only counts above zero are kept."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = [
        ("self link", links.where("a = b")), ("linked and rejected", pair(links).join(pair(rejected), ["a", "b"], "left_semi")), ("pending and rejected", pair(pending).join(pair(rejected), ["a", "b"], "left_semi")),
        ("stored both ways", links.where("a < b").select("a", "b").join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")),
    ]
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in found]
    return reduce(DataFrame.unionByName, rows).where("rows > 0")


def crossing(products: DataFrame, links: DataFrame, least_conf: int = 50) -> DataFrame:
    """Per brand: its products, and those with a trusted link to another brand."""
    step = both_ways(links.where(F.col("conf") >= least_conf)).join(products.select(F.col("id").alias("b"), F.col("brand").alias("other")), "b").select(F.col("a").alias("id"), "other")
    crossed = step.join(products.select("id", "brand"), "id").where("other <> brand").select("id").distinct().withColumn("crosses", F.lit(1))
    return products.join(crossed, "id", "left").groupBy("brand").agg(F.count("*").alias("products"), F.count("crosses").alias("crossing"))


def completeness(products: DataFrame, linked: DataFrame, priced: DataFrame) -> DataFrame:
    """Per brand and in all (brand null): products, linked ones and those with a recent price. linked, priced: id."""
    rows = products.join(linked.select("id").distinct().withColumn("l", F.lit(1)), "id", "left").join(priced.select("id").distinct().withColumn("p", F.lit(1)), "id", "left")
    return rows.rollup("brand").agg(F.count("*").alias("products"), F.count("l").alias("linked"), F.count("p").alias("priced"))


def dead_links(products: DataFrame, links: DataFrame) -> DataFrame:
    """Products of supplier brands that have links, none of which leads to another supplier's product or to a maker's
    product with more than one link. products: id, oem."""
    step = both_ways(links)
    degree = step.groupBy("a").agg(F.count("*").alias("degree"))
    of = products.select("id", "oem")
    to = step.join(of.toDF("b", "oem_b"), "b").join(degree.toDF("b", "degree_b"), "b").select("a", (~F.col("oem_b") | (F.col("degree_b") > 1)).alias("alive"))
    return to.groupBy("a").agg(F.max("alive").alias("alive")).where(~F.col("alive")).join(of.where(~F.col("oem")).select(F.col("id").alias("a")), "a").select(F.col("a").alias("id"))


def lots_out_of_line(lots: DataFrame, times: float = 3.0) -> DataFrame:
    """Lots much larger than the upper median of the earlier lots of their rule. lots: rule, lot, size, one row per lot.
    The sizes seen are kept sorted, so a rule of n lots takes n insertions and not n lists."""
    rows = lots.select("rule", "lot", F.col("size").cast("long").alias("size"))

    def run(group):
        group, seen, usual = group.sort_values("lot"), [], []
        for x in group["size"].tolist():
            usual.append(seen[len(seen) // 2] if seen else -1)
            insort(seen, x)
        group["usual"] = usual
        return group[(group["usual"] >= 0) & (group["size"] > times * group["usual"])]

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("rule").applyInPandas(run, f"{head}, usual long")


def control_sample(pairs: DataFrame, size: int, group: str = "brand") -> DataFrame:
    """A repeatable sample of each group: the first by a hash; all where little more than the sample is left. pairs: a, b, group."""
    h = F.md5(F.concat_ws("/", group, "a", "b"))
    w = Window.partitionBy(group)
    rows = pairs.withColumns({"place": F.row_number().over(w.orderBy(h, "a", "b")), "n": F.count("*").over(w)})
    return rows.where((F.col("place") <= size) | (F.col("n") <= 1.3 * size)).select(group, "a", "b")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled share, share of digits-only values, mean length, distinct values; what roles are guessed from."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    filled = F.col("v").isNotNull() & (F.trim("v") != "")
    return long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(filled).alias("filled"), F.count_if(F.col("v").rlike("^[0-9]+$")).alias("digits"),
        F.round(F.avg(F.when(filled, F.length("v"))), 4).alias("mean_length"), F.count_distinct("v").alias("kinds"),
    )


def inbox(messages: DataFrame) -> DataFrame:
    """Conversations, those that wait for an answer first: turns, unanswered ones (since the last answer), last author."""
    answered = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = messages.withColumn("answered", F.coalesce(answered, F.lit(-1)))
    g = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if((F.col("role") == "user") & (F.col("turn") > F.col("answered"))).alias("waiting"), F.max(F.struct("turn", "role")).alias("x"))
    return g.select("conv_id", "turns", "waiting", F.col("x.role").alias("last_role"))


def what_separates(items: DataFrame, questions: list[str]) -> DataFrame:
    """Per question (a column): how many answers it has, and how many items an answer is expected to leave (the sum of
    squares of its groups over the sum); the fewer, the better the question."""
    long = items.select(F.explode(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).cast("string").alias("answer")) for c in questions])).alias("x")).select("x.*")
    groups = long.groupBy("question", "answer").agg(F.count("*").alias("n"))
    return groups.groupBy("question").agg(F.count("*").alias("answers"), F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n"), 6).alias("left"))


def coverage(products: DataFrame, linked: DataFrame, trusted: DataFrame) -> DataFrame:
    """Products, linked ones and those with a trusted link: by family, and by list. products: id, family, list."""
    rows = products.join(linked.select("id").distinct().withColumn("l", F.lit(1)), "id", "left").join(trusted.select("id").distinct().withColumn("t", F.lit(1)), "id", "left")
    return rows.groupingSets([["family"], ["list"]], "family", "list").agg(F.count("*").alias("products"), F.count("l").alias("linked"), F.count("t").alias("trusted"))
