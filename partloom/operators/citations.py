"""Codes that texts name: whole ones, also with a blank, dot, dash or slash within, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.checks import is_kit
from partloom.functions.staging import staged
from partloom.functions.text import without_marks

#: Pieces of a code that a text may hold apart, characters of a code that is looked for, and of one looked for in kits.
PIECES, LEAST, LEAST_IN_KIT = 4, 4, 6
# What stands before the numbers that a supplier declares to be the maker's.
DECLARED = r"(?:REF\.?\s*ORIG|//|\bOEM\b|\bEQUIVALE)"


def spans(text: Column, pieces: int = PIECES) -> Column:
    """What a text may name as a code: up to `pieces` neighbouring runs of letters and digits, with one of blank, dot, dash and
    slash between each two, written together; with a digit and LEAST characters or more."""
    chains = F.regexp_extract_all(F.upper(without_marks(text)), F.lit(r"[A-Z0-9]+(?:[\s.\-/][A-Z0-9]+)*"), F.lit(0))
    runs = F.transform(chains, lambda c: F.split(c, r"[\s.\-/]"))

    def glued(k: int) -> Column:
        of = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - k + 1), lambda i: F.array_join(F.slice(r, i, F.lit(k)), ""))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.size(r) >= k), of))

    every = F.concat(*[glued(k) for k in range(1, pieces + 1)])
    return F.array_distinct(F.filter(every, lambda s: (F.length(s) >= LEAST) & s.rlike("[0-9]")))


def declared(text: Column) -> Column:
    """The part of a text from its first declaration on; null if it declares nothing."""
    return F.nullif(F.regexp_extract(F.upper(text), rf"(?s){DECLARED}(.*)$", 1), F.lit(""))


def cited(texts: DataFrame, codes: DataFrame, pieces: int = PIECES) -> DataFrame:
    """id and code: the codes of LEAST characters and a digit or more that texts name. texts: id, text. codes: code, cleaned.
    Texts meet codes by what they may name; a code in very many texts is split by adaptive execution."""
    wanted = codes.select("code").where((F.length("code") >= LEAST) & F.col("code").rlike("[0-9]")).distinct()
    return texts.select("id", F.explode(spans(F.col("text"), pieces)).alias("code")).join(wanted, "code").select("id", "code")


def written_pairs(products: DataFrame, linked: DataFrame, pending: DataFrame) -> DataFrame:
    """a, b: pairs of products of different brands of which one's description declares the other's code, and that are neither
    linked nor pending, nor a set and a part. products: id, brand, code, text; linked, pending: a, b."""
    # Texts are read once, a task for each share of them; what meets are narrow rows.
    read = products.select("id", "brand", "code", is_kit(F.col("text")).alias("kit"), F.coalesce(spans(declared(F.col("text"))), F.array().cast("array<string>")).alias("named"))
    read = staged(read, "declared_codes")
    found = read.select("id", F.col("brand").alias("by"), F.col("kit").alias("by_kit"), F.explode("named").alias("code"))
    other = read.where((F.length("code") >= LEAST) & F.col("code").rlike("[0-9]")).select(F.col("id").alias("other"), "brand", "code", "kit")
    rows = found.join(other, "code").where("id <> other and by <> brand and by_kit = kit")
    out = rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    known = linked.select("a", "b").unionByName(pending.select("a", "b"))
    return out.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def kit_parts(products: DataFrame) -> DataFrame:
    """kit and part: sets and the products whose code (LEAST_IN_KIT characters or more) their description names; of products with
    one description the one that can be sold, and of sets with one description too: priced, then in stock, then the least id. A
    product with the set's own description is the set. products: id, code, text, price, stock."""
    sold = lambda i: (F.col("price").isNull(), F.coalesce("stock", F.lit(0)) <= 0, F.col(i))
    first = lambda rows, by, i: rows.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*sold(i)))).where("_p = 1").drop("_p")
    # Sets of one description name the same codes, so the best of them stands for all; products of one code and description
    # likewise. Sets that name the same codes hold the same products, and each takes the list at the end.
    kits = first(products.where(is_kit(F.col("text"))).select("id", "text", F.trim("text").alias("kit_text"), "price", "stock"), ["kit_text"], "id")
    parts = products.where(F.length("code") >= LEAST_IN_KIT).select(F.col("id").alias("part"), "code", F.trim("text").alias("of"), "price", "stock")
    parts = first(parts, ["code", "of"], "part")
    named = cited(kits.select("id", "text"), parts.select("code")).distinct().groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    named = staged(named.join(kits.select("id", "kit_text"), "id"), "named_codes")
    lists = named.select("codes").distinct().select("codes", F.explode("codes").alias("code")).join(parts, "code")
    lists = first(lists, ["codes", "of"], "part").select("codes", "part", "of")
    return lists.join(named, "codes").where("not (of <=> kit_text)").select(F.col("id").alias("kit"), "part")
