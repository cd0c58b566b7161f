"""Rows as JSON and nested values: quotes, trash, noisy answers, questions that part versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def quotes(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per quote: its items as JSON in order, and the total. items: code, units, price. A quote has few items."""
    line = F.struct(F.col(order), "code", "units", "price")
    g = items.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("x"), F.round(F.sum(F.col("units") * F.col("price")), 2).alias("total"))
    return g.select(key, F.to_json(F.transform("x", lambda i: F.struct(i["code"].alias("code"), i["units"].alias("units"), i["price"].alias("price")))).alias("items"), "total")


def to_trash(rows: DataFrame, key: str, table: str) -> DataFrame:
    """Rows taken out of a table, kept as JSON: table, key and data."""
    return rows.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("data"))


def from_trash(trash: DataFrame, schema: StructType, table: str) -> DataFrame:
    """The rows of a table as they were. Columns that the trash does not know are null."""
    return trash.where(F.col("table") == table).select(F.from_json("data", schema).alias("x")).select("x.*")


def first_json(c: Column) -> Column:
    """The object in a text that may say more: from its first brace to its last, of the first fenced block that begins with one
    if there is such a block; null if that cannot be read."""
    fenced = F.transform(F.split(c, "```"), lambda x: F.regexp_replace(x, "^(?i)json", ""))
    block = F.get(F.filter(fenced, lambda x: F.ltrim(F.regexp_replace(x, r"^\s+", "")).startswith("{")), 0)
    text = F.when(c.contains("```"), F.coalesce(block, c)).otherwise(c)
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.json_array_length(F.concat(F.lit("["), found, F.lit("]"))) == 1, found)


def versions(answers: DataFrame) -> DataFrame:
    """Per product: question to answer to codes, as nested maps; questions that all codes answer alike are left out. answers:
    product, question, answer, code. A product has few of each."""
    by = answers.groupBy("product", "question", "answer").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    q = by.groupBy("product", "question").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("answer", "codes")))).alias("answers")).where(F.size("answers") > 1)
    return q.groupBy("product").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", F.map_entries("answers").alias("e"))))).alias("m")).select("product", F.transform_values("m", lambda k, e: F.map_from_entries(e)).alias("versions"))
