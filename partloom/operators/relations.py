"""Pairs and matches that follow from other relations: replacements, families, kits, combinations, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import staged


def replacement_bridges(replacements: DataFrame, products: DataFrame, links: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of a product of a replaced code and one of its replacement that are neither linked nor rejected. replacements:
    old, new; products: id, code; links, rejected: a, b."""
    pairs = replacements.join(products.select(F.col("id").alias("x"), F.col("code").alias("old")), "old").join(products.select(F.col("id").alias("y"), F.col("code").alias("new")), "new")
    out = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for other in (links, rejected):
        out = out.join(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return out


def family_of_nodes(steps: DataFrame, families: DataFrame, nodes: DataFrame) -> DataFrame:
    """Family of each maker's number: that of most of its neighbours; of equals the first by name. steps: a, b, both ways;
    families: id, family; nodes: id."""
    n = steps.join(nodes.withColumnRenamed("id", "a"), "a").join(families.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "family").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "family")
    return n.withColumn("place", F.row_number().over(w)).where("place = 1").select("id", "family", "n")


def matched(lines: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Lines of a delivery note with what the catalogue has for each code: how many products, and the dearest price."""
    had = catalogue.groupBy(key).agg(F.count("*").alias("found"), F.max("price").alias("price"))
    return lines.join(had, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))


def changed(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Keys in both whose value differs, with both; spelling in capitals and blanks aside."""
    plain = lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    both = before.select(key, F.col(value).alias("old")).join(now.select(key, F.col(value).alias("new")), key)
    return both.where(~plain(F.col("old")).eqNullSafe(plain(F.col("new"))))


def goes_with(names: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """What usually goes with a part, by words of its name. names: id, name. rules are a fixed, short list."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(word)), other) for word, other in rules]))
    return names.select("id", F.explode(F.array_distinct(found)).alias("other"))


def co_named(names: DataFrame, words: str = "words") -> DataFrame:
    """Words that names hold together, as unordered pairs, with how many names of the group do. Equal names are one, with
    their number. names: family, words (distinct)."""
    few = names.select("family", F.array_sort(words).alias("w")).groupBy("family", "w").agg(F.count("*").alias("n"))
    pairs = few.select("family", "n", F.explode("w").alias("a"), "w").select("family", "n", "a", F.explode("w").alias("b")).where("a < b")
    return pairs.groupBy("family", "a", "b").agg(F.sum("n").alias("names"))


def removable(products: DataFrame, *used: DataFrame) -> DataFrame:
    """Products to which nothing is attached. used: tables with the ids that something is attached to."""
    for u in used:
        products = products.join(u.select("id"), "id", "left_anti")
    return products


def words_to_ids(index: DataFrame, asked: DataFrame, least: float = 2 / 3) -> DataFrame:
    """Rows that hold at least the share `least` of each search's words, with how many. index: word, ids (array); asked: search,
    word. Words of one search count once each."""
    # Searches for the same words are answered once: a search takes what its set of words has found.
    sets = asked.distinct().groupBy("search").agg(F.array_sort(F.collect_set("word")).alias("words"), F.count("*").alias("n"))
    sets = staged(sets, "word_sets")
    words = sets.groupBy("words", "n").agg(F.min("search").alias("first"))
    named = words.select("first", "n", F.explode("words").alias("word"))
    hits = named.join(index, "word").select("first", "n", F.explode("ids").alias("id")).groupBy("first", "n", "id").agg(F.count("*").alias("hits"))
    enough = hits.where(F.col("hits") >= F.ceil(F.col("n") * least - 1e-9)).select("first", "id", "hits")
    alike = sets.join(words, ["words", "n"]).select("search", "first")
    return enough.join(alike, "first").select("search", "id", "hits")


#: Ids that one row of an index covers, so that a word in every text makes many rows of bounded size.
BLOCK = 10_000


def inverted(rows: DataFrame, words: str = "words") -> DataFrame:
    """An index: word, block (ids by ten thousands) and ids in order. rows: id, words."""
    return rows.select("id", F.explode(words).alias("word")).groupBy("word", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
