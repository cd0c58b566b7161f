"""Fitment catalogues: rows of cells in which a maker's title and a model stand once, above what they hold for.

Which title and model a row belongs to is carried down the lines of its file. Lines are dealt in blocks: within a block by a
window, and from block to block by what each leaves, so that one long file is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.extract import split_codes
from partloom.functions.text import sanitize

#: Lines of one block.
BLOCK = 10_000
# How catalogues say that a table goes on, and that years begin or end.
GOES_ON = r"(?i)\s*[-–(]?\s*(continuaci[oó]n|continua[cç][aã]o|cont\.?)\s*\)?\s*$"
SINCE, UNTIL = r"(?i)desde|a partir", r"(?i)\bat[ée](?![a-z])|hasta"
RANGE = r"(?i)(19|20)\d{2}\s*(a|-|hasta|até)\s*(19|20)\d{2}|desde\s*(19|20)\d{2}|at[ée]\s*(19|20)\d{2}"


def carried(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """rows with each of the columns, where it is null, as the last row above in order has it. order: whole numbers."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = blocked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    left = blocked.groupBy(key, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    enters = left.withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(before) for c in columns})
    out = within.join(enters, [key, "_block"]).withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
    return out.drop("_block", *[f"_{c}" for c in columns])


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def title(cells: Column) -> Column:
    """The maker that a row is the title of: text in the first cell alone, short, mostly capitals; null for other rows."""
    base = F.trim(F.regexp_replace(tidy(F.get(cells, 0)), GOES_ON, ""))
    letters = F.regexp_replace(base, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    alone = ~F.exists(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda x: tidy(x) != "")
    return F.when(alone & (base != "") & (F.length(base) <= 30) & (F.length(letters) > 0) & (capitals > 0.7 * F.length(letters)), F.upper(base))


def years(text: Column) -> Column:
    """struct(first, last) of the years that a cell states; an open end is null, and so is the last of a single year."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(19\d{2}|20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    low, high = F.array_min(found), F.array_max(found)
    s = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    none = F.lit(None).cast("int")
    return F.when(F.size(found) <= 0, s(none, none)).when(text.rlike(SINCE), s(low, none)).when(text.rlike(UNTIL), s(none, high)).otherwise(s(low, F.when(high != low, high)))


def columns_of(rows: DataFrame) -> DataFrame:
    """Per file: in which cells the years and the code stand, by what most of its rows have there; of equals the first. The code
    is never in the first two. rows: file, cells."""
    cells = rows.select("file", F.posexplode("cells").alias("at", "cell")).withColumn("v", tidy(F.col("cell")))
    year = F.col("v").rlike(r"19\d{2}|20\d{2}") | F.col("v").rlike(r"(?i)desde|at[ée]|hasta")
    code = ~year & F.upper("v").rlike(r"^[A-Z0-9][A-Z0-9\-./ ]{2,28}$") & F.col("v").rlike("[0-9]") & F.upper("v").rlike("[A-Z]")
    n = cells.groupBy("file", "at").agg(F.count_if(year).alias("year"), F.count_if(code).alias("code"))
    most = n.groupBy("file").agg(F.max_by("at", F.struct("year", F.negative("at"))).alias("years_at"), F.max("year").alias("any"), F.max("at").alias("last"))
    most = most.withColumn("years_at", F.when(F.col("any") > 0, F.col("years_at")).otherwise(F.lit(3)))
    rest = n.join(most, "file").where("at > 1 and at <> years_at").groupBy("file").agg(F.max_by("at", F.struct("code", F.negative("at"))).alias("code_at"))
    return most.join(rest, "file", "left").select("file", "years_at", F.coalesce("code_at", "last").alias("code_at"))


def looks_like_one(rows: DataFrame, makers: DataFrame) -> DataFrame:
    """Files that are fitment catalogues and no price lists: ten rows or more, two of them titles of known makers, and a cell
    that in three of ten rows states a range of years. rows: file, line, cells; makers: name, in capitals."""
    full = rows.where(F.exists("cells", lambda x: tidy(x) != ""))
    titles = full.select("file", title(F.col("cells")).alias("name")).join(makers.select("name").distinct(), "name").groupBy("file").agg(F.count("*").alias("titles"))
    ranged = full.select("file", F.posexplode("cells").alias("at", "cell")).where(F.col("cell").rlike(RANGE)).groupBy("file", "at").agg(F.count("*").alias("n")).groupBy("file").agg(F.max("n").alias("ranged"))
    n = full.groupBy("file").agg(F.count("*").alias("rows"))
    return n.join(titles, "file").join(ranged, "file").where("rows >= 10 and titles >= 2 and ranged >= 0.3 * rows").select("file", "titles")


def parsed(rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """file, line, maker, model, engine, fuel, first, last, code: which part fits which car. rows: file, line, cells: model,
    engine, fuel, and years and codes where columns says (file, years_at, code_at; found if not given). A title forgets the
    model above it; a row without either is left out, as are codes of two characters or without a digit."""
    at = columns_of(rows) if columns is None else columns
    full = rows.where(F.exists("cells", lambda x: tidy(x) != "")).join(at, "file").withColumn("title", title(F.col("cells")))
    cell = lambda k: tidy(F.get("cells", k))
    code = tidy(F.get("cells", F.col("code_at")))
    named = F.when(F.col("title").isNull() & (code != "") & (cell(F.lit(0)) != ""), F.upper(cell(F.lit(0))))
    state = full.withColumns({"maker": F.when(F.col("title").isNotNull(), F.struct(F.col("line").alias("at"), F.col("title").alias("v"))), "model": F.when(named.isNotNull(), F.struct(F.col("line").alias("at"), named.alias("v")))})
    told = carried(state, "file", "line", ["maker", "model"]).where(F.col("title").isNull() & (code != "") & (F.col("model.at") > F.col("maker.at")))
    y = years(tidy(F.get("cells", F.col("years_at"))))
    out = told.select("file", "line", F.col("maker.v").alias("maker"), F.col("model.v").alias("model"), cell(F.lit(1)).alias("engine"), cell(F.lit(2)).alias("fuel"), y.alias("y"), code.alias("cell"))
    several = F.when(F.size(split_codes(F.col("cell"))) > 0, split_codes(F.col("cell"))).otherwise(F.array(sanitize(F.col("cell"))))
    out = out.select("file", "line", "maker", "model", "engine", "fuel", "y.first", "y.last", F.explode(several).alias("code"))
    return out.where((F.length("code") > 2) & F.col("code").rlike("[0-9]"))


def crossed(fitments: DataFrame, least: int = 2) -> DataFrame:
    """a, b and cars: codes that fit `least` cars or more alike (maker, model, engine, years that meet). A car is stated by few
    codes of a kind; the codes of each car are made one row for each before they meet. fitments: as parsed() has them."""
    car = ["maker", "model", "engine"]
    rows = fitments.groupBy(*car, "code").agg(F.min(F.coalesce("first", F.lit(0))).alias("lo"), F.max(F.coalesce("last", F.when(F.col("first").isNotNull() & F.col("last").isNull(), 9999), F.lit(9999))).alias("hi"))
    x, y = rows.toDF(*car, "a", "lo_a", "hi_a"), rows.toDF(*car, "b", "lo_b", "hi_b")
    met = x.join(y, car).where("a < b and lo_a <= hi_b and lo_b <= hi_a")
    return met.groupBy("a", "b").agg(F.count("*").alias("cars")).where(F.col("cars") >= least)


def fits(asked: DataFrame, fitments: DataFrame) -> DataFrame:
    """asked with fits (null: no catalogue knows the code), why (`no data`, `other car`, `other year`; null if it fits) and engines,
    those it fits. A maker and model are asked for by a part of their names; an empty model, or no year, leaves it open, an empty maker
    fits no car, as in the reference. asked:
    ask (a number of its own), code, maker, model, year; fitments: as parsed() has them."""
    own = asked.withColumns({"_maker": F.upper(F.trim(F.coalesce("maker", F.lit("")))), "_model": F.upper(F.trim(F.coalesce("model", F.lit(""))))})
    f = fitments.select("code", F.col("maker").alias("m"), F.col("model").alias("n"), F.col("engine").alias("e"), F.col("first").alias("lo"), F.col("last").alias("hi")).distinct()
    # What is asked alike is looked up once, and what catalogues say again counts once; a row of asked takes its answer.
    one = ["code", "_maker", "_model", "year"]
    met = own.select(*one).distinct().join(f, "code", "left")
    car = (F.col("_maker") != "") & F.contains("m", F.col("_maker")) & F.contains("n", F.col("_model"))
    year = F.col("year").isNull() | ((F.coalesce("lo", "year") <= F.col("year")) & (F.coalesce("hi", "year") >= F.col("year")))
    g = met.groupBy(*one).agg(F.count("m").alias("known"), F.count_if(car).alias("cars"), F.count_if(car & year).alias("good"), F.array_sort(F.collect_set(F.when(car & year & (F.col("e") != ""), F.col("e")))).alias("engines"))
    why = F.when(F.col("known") == 0, "no data").when(F.col("cars") == 0, "other car").when(F.col("good") == 0, "other year")
    g = g.select(*[F.col(c).alias(f"_of{c}") for c in one], F.when(F.col("known") > 0, F.col("good") > 0).alias("fits"), why.alias("why"), "engines")
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in one]
    return own.join(g, same).select(*asked.columns, "fits", "why", "engines")


def for_same_cars(asked: DataFrame, fitments: DataFrame, products: DataFrame) -> DataFrame:
    """code, id and cars: products of other makers of parts whose codes fit cars that an asked code fits, of the same kind of part,
    and how many such cars. asked: code; fitments: as parsed() has them, with brand and kind; products: id, code. An empty kind
    says nothing. A car's codes of one kind meet once for each, whatever the lines that say so."""
    key = ["maker", "model", "engine", "kind"]
    known = fitments.where("kind <> ''").select("code", "brand", *key).distinct()
    mine = known.join(asked.select("code").distinct(), "code").select("code", F.col("brand").alias("by"), *key)
    other = known.select(F.col("code").alias("with"), F.col("brand").alias("of"), *key)
    pairs = mine.join(other, key).where("by <> of").select("code", "with", "maker", "model", "engine").distinct()
    cars = pairs.groupBy("code", "with").agg(F.count_distinct("maker", "model", "engine").alias("cars"))
    return cars.join(products.select("id", F.col("code").alias("with")), "with").select("code", "id", "cars")
