"""Where to put what sells: free shelf places by how far one walks to them, and best sellers by rank.

The floor is a grid of cells. Steps from the entrances spread over free cells a round at a time, all floors together; a cell keeps the
round in which it was first reached, so a round looks back at the last two only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import dropped, staged

#: Steps that a shelf's height is worth: the second is at hand, then the third, the lowest, and those above.
HEIGHT = 4


def discomfort(level: Column) -> Column:
    return F.when(level == 1, 3).when(level == 2, 0).when(level == 3, 1).otherwise(2 * level - 4)


def steps(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """floor, x, y, steps: the free cells that one can walk to, and the least steps from any start of the floor. cells: floor, x,
    y, free; starts: floor, x, y. What is not free is not walked over."""
    free = staged(cells.where("free").select("floor", "x", "y").distinct(), "free_cells")
    key = ["floor", "x", "y"]
    front = staged(starts.select(*key).distinct().join(free, key).withColumn("steps", F.lit(0)), "walk")
    rounds, last = [front], None
    n = 0
    while not front.isEmpty():
        n += 1
        moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        near = front.select("floor", "x", "y", F.explode(moves).alias("m")).select("floor", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y")).distinct()
        seen = front if last is None else front.unionByName(last)
        after = near.join(free, key).join(seen.select(*key), key, "left_anti").withColumn("steps", F.lit(n))
        last, front = front, staged(after, "walk")
        rounds.append(front)
    if len(rounds) > 1:
        dropped(rounds.pop())
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def free_places(shelves: DataFrame, walked: DataFrame, occupied: DataFrame) -> DataFrame:
    """depot, floor, shelf, module, level and cost of every free place that can be reached: the steps to a cell beside its
    module and the discomfort of its height. shelves: depot, floor, shelf, module, x, y, levels; walked: as steps() has it;
    occupied: shelf, module, level."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    beside = shelves.select("depot", "floor", "shelf", "module", "levels", "x", "y", F.explode(moves).alias("m")).select("depot", "floor", "shelf", "module", "levels", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"))
    near = beside.join(walked, ["floor", "x", "y"]).groupBy("depot", "floor", "shelf", "module", "levels").agg(F.min("steps").alias("steps"))
    places = near.select("depot", "floor", "shelf", "module", "steps", F.explode(F.sequence(F.lit(1), F.greatest("levels", F.lit(1)))).alias("level"))
    free = places.join(occupied.select("shelf", "module", "level"), ["shelf", "module", "level"], "left_anti")
    return free.select("depot", "floor", "shelf", "module", "level", (F.col("steps") + 1 + HEIGHT * discomfort(F.col("level"))).alias("cost"))


def suggested(products: DataFrame, places: DataFrame, top: int = 15) -> DataFrame:
    """rank, id, depot, floor, shelf, module, level, cost: the `top` products without a place that sold most (then were asked for
    most, then have most in stock) with the nearest free places, first depots and floors first. products: id, sold, asked, stock."""
    best = products.where("stock > 0 or sold > 0").orderBy(F.desc("sold"), F.desc("asked"), F.desc("stock"), "id").limit(top)
    near = places.orderBy("depot", "floor", "cost", "shelf", "module", "level").limit(top)
    # Both sides are the few rows of a report.
    rank = lambda *by: F.row_number().over(Window.partitionBy().orderBy(*by))
    left = best.select("id", rank(F.desc("sold"), F.desc("asked"), F.desc("stock"), "id").alias("rank"))
    return left.join(near.withColumn("rank", rank("depot", "floor", "cost", "shelf", "module", "level")), "rank")
