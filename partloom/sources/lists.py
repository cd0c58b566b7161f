"""Supplier price lists: files of any encoding and separator to rows of cells, header row, column roles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions.text import without_marks

# Encodings in the order in which they are tried, and separators that are looked for.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SEPARATORS = (";", "\t", "|", ",")
# Title words that tell a column's role.
ROLES = {
    "barcode": ("codigo de barras", "cod barras", "ean", "barra", "barras", "gtin", "upc"), "code": ("codigo", "cod", "code", "sku", "item"), "maker_code": ("oem", "original", "equivalencia", "referencia"), "description": ("descripcion articulo", "descripcion", "detalle", "description", "producto", "articulo", "nombre"),
    "price": ("precio", "price", "lista", "importe", "pvp"), "stock": ("stock", "existencia", "cantidad", "disponible"),
}


def decode(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def separator(text: str) -> str:
    """The separator that parts most of the lines into the same number of cells, two or more."""
    lines = [x for x in text.splitlines() if x.strip()]

    def score(sep: str) -> tuple[int, int]:
        usual, times = Counter(x.count(sep) for x in lines).most_common(1)[0]
        return (times if usual else 0, usual)

    return max(SEPARATORS, key=score) if lines else ";"


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, hash of the content, row_no and cells, one row per line. Files are read whole, one at a time in a task; a
    price list is bounded by what a supplier sends."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import hashlib

        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                text = decode(bytes(raw))
                rows = [[c.strip() for c in r] for r in csv.reader(text.splitlines(), delimiter=separator(text))]
                rows = [r for r in rows if any(r)]
                yield pd.DataFrame({"file": p, "hash": hashlib.sha256(bytes(raw)).hexdigest(), "row_no": range(len(rows)), "cells": rows})

    return files.mapInPandas(run, "file string, hash string, row_no long, cells array<string>")


def header_rows(rows: DataFrame, first: int = 25) -> DataFrame:
    """file and header: of each file's first rows, the one most like a header: filled cells without digits, and title
    words; the earliest of equals; null if none has two such cells."""
    words = [w for own in ROLES.values() for w in own]
    low = F.transform("cells", lambda c: F.lower(without_marks(c)))
    named = F.size(F.filter(low, lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))))
    plain = F.size(F.filter(low, lambda c: (c != "") & ~c.rlike("[0-9]")))
    scored = rows.where(F.col("row_no") < first).select("file", "row_no", (named * 3 + plain).alias("score"), plain.alias("plain"))
    best = scored.groupBy("file").agg(F.max(F.struct("score", F.negative("row_no").alias("r"), "plain")).alias("x"))
    return best.select("file", F.when((F.col("x.plain") >= 2) & (F.col("x.score") > F.col("x.plain")), -F.col("x.r")).alias("header"))


def roles_by_title(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """file, column and role by the header's words. A column has one role, that of the longest word it names (of equals in the
    order of ROLES: barcodes before codes); a role goes to the column with the longest word, the first of equals."""
    cells = rows.join(headers, "file").where("row_no = header").select("file", F.posexplode("cells").alias("column", "title"))
    low = F.regexp_replace(F.lower(without_marks(F.col("title"))), "[^a-z0-9]+", " ")
    words = [(k, w, role) for k, (role, own) in enumerate(ROLES.items()) for w in own]
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit(len(w)).alias("size"), F.lit(-k).alias("rank"), F.lit(role).alias("role"))) for k, w, role in words]))
    named = cells.select("file", "column", F.array_max(hits).alias("x")).where("x is not null")
    best = F.max(F.struct("x.size", F.negative("column").alias("c"))).alias("best")
    return named.groupBy("file", F.col("x.role").alias("role")).agg(best).select("file", "role", F.negative("best.c").alias("column"))


def roles_by_data(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """file, column and role from what columns hold: prices are numbers with decimals, barcodes 12 to 14 digits, codes
    short and distinct with digits, descriptions long with blanks."""
    body = rows.join(headers, "file").where(F.coalesce(F.col("row_no") > F.col("header"), F.lit(True))).select("file", F.posexplode("cells").alias("column", "v")).where("v <> ''")
    share = lambda p: F.avg(F.col("v").rlike(p).cast("double"))
    prof = body.groupBy("file", "column").agg(
        share(r"^\$?\s*[0-9][0-9.,]*[.,][0-9]{1,2}$").alias("money"), share("^[0-9]{12,14}$").alias("gtin"), share("^[0-9]{1,4}$").alias("small"), share("[0-9]").alias("digit"), share(r"\S\s+\S").alias("blank"),
        F.avg(F.length("v")).alias("size"), (F.approx_count_distinct("v") / F.count("*")).alias("kinds"),
    )
    role = (
        F.when(F.col("gtin") > 0.7, "barcode").when(F.col("money") > 0.6, "price").when((F.col("blank") > 0.6) & (F.col("size") >= 10), "description")
        .when(F.col("small") > 0.8, "stock").when((F.col("digit") > 0.7) & (F.col("size") <= 20) & (F.col("kinds") > 0.6), "code")
    )
    named = prof.select("file", "column", role.alias("role")).where("role is not null")
    first = F.row_number().over(Window.partitionBy("file", "role").orderBy("column"))
    return named.withColumn("n", first).where("n = 1").drop("n")


def not_imported(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of files whose content was not imported before. log: hash."""
    return rows.join(log.select("hash").distinct(), "hash", "left_anti")
