"""An index of texts by trigrams, kept up with changes, and searches that are answered from it.

A folder holds numbered parts: folded texts, postings (trigram, block of ids, ids in order), and the ids that the part replaces.
A change adds a part; what a later part names counts no more in earlier ones. Many changes make a new index instead. A part
counts once its last table is written, so a lost job leaves no half of one. Postings only narrow a search: every row they give is verified on its text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions.staging import importable
from partloom.functions.text import without_marks

#: Ids of one row of postings, and changed ids from which an index is made anew.
BLOCK, MANY = 10_000, 2000
#: Rows of equal merit that a search gives.
TOP = 200
#: Bytes of text whose trigrams a task sorts at a time, and the letters of trigrams in order.
HELD, LETTERS = 4_000_000, "0123456789abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    return F.lower(without_marks(F.coalesce(text.cast("string"), F.lit(""))))


def trigrams(f: Column) -> Column:
    """All runs of three letters or digits, each once."""
    return F.array_distinct(F.regexp_extract_all(f, F.lit("(?=([a-z0-9]{3}))"), F.lit(1)))


def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, block and ids of rows (id, folded text): the trigrams() of each text, sorted by number in one go for all texts of
    HELD bytes. Bytes that are no letter or digit end a run, so letters of several bytes do."""
    base = len(LETTERS)
    rank = np.full(256, -1, np.int32)
    rank[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(base)
    names = pa.array([x + y + z for x in LETTERS for y in LETTERS for z in LETTERS])
    for batch in batches:
        ids, texts_ = batch.column(0).to_numpy(), batch.column(1)
        data = np.frombuffer(texts_.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(texts_.buffers()[1], np.int32)[texts_.offset : texts_.offset + len(texts_) + 1] if len(texts_) else np.zeros(1, np.int32)
        begin = 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(ends, int(ends[begin]) + HELD, "right")) - 1)
            order = np.argsort(ids[begin:end], kind="stable")
            place = np.empty(end - begin, np.int64)
            place[order] = np.arange(end - begin)
            own, letter = ids[begin:end][order], rank[data[ends[begin] : ends[end]]]
            text = np.repeat(np.arange(end - begin, dtype=np.int32), np.diff(ends[begin : end + 1]))
            at = np.flatnonzero((letter[:-2] >= 0) & (letter[1:-1] >= 0) & (letter[2:] >= 0) & (text[:-2] == text[2:]))
            begin = end
            if not len(at):
                continue
            number = (letter[at] * base + letter[at + 1]) * base + letter[at + 2]
            number, which = np.divmod(np.unique(number * np.int64(len(own)) + place[text[at]]), len(own))
            held = own[which]
            block = held // BLOCK
            first = np.concatenate([[0], 1 + np.flatnonzero((np.diff(number) != 0) | (np.diff(block) != 0))])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(held)), pa.int32()), pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number[first])), pa.array(block[first], pa.int64()), lists], names=["trigram", "block", "ids"])


def _add(path: str, part: int, rows: DataFrame, replaced: DataFrame | None) -> None:
    at = lambda kind: f"{path}/{kind}/part={part}"
    texts = rows.select("id", folded(F.col("text")).alias("f"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    texts.write.parquet(at("texts"))
    spark = rows.sparkSession
    importable(spark)
    own = spark.read.parquet(at("texts"))
    # A task's lists are few rows; one shuffle puts them together in the order in which they are written.
    lists = own.select("id", "f").mapInArrow(listed, "trigram string, block long, ids array<long>").groupBy("trigram", "block").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    lists.sortWithinPartitions("trigram", "block").write.parquet(at("postings"))
    # The table that makes the part count comes last.
    gone = replaced if replaced is not None else own.select("id").limit(0)
    gone.select(F.col("id").cast("long")).distinct().write.parquet(at("replaced"))


def build(rows: DataFrame, path: str) -> str:
    """Index rows (id, a long that occurs once; text) in a new folder."""
    _add(path, 0, rows.select(F.col("id").cast("long"), "text"), None)
    return path


def _last(spark: SparkSession, path: str) -> int:
    """The number of the last part that counts."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/replaced")
    names = [s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder)]
    return max(int(n.split("=")[1]) for n in names if n.startswith("part="))


def update(rows: DataFrame, changed: DataFrame, path: str, anew: str, many: int = MANY) -> str:
    """The index brought up to rows, of which changed (id) names those that came, went or differ. More than `many` changes
    make an index in the folder `anew`; the folder that counts is returned."""
    ids = changed.select(F.col("id").cast("long")).where("id is not null").distinct()
    n = ids.limit(many + 1).count()
    if n > many:
        return build(rows, anew)
    if n:
        _add(path, _last(rows.sparkSession, path) + 1, rows.select(F.col("id").cast("long"), "text").join(ids, "id", "left_semi"), ids)
    return path


def _live(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """A table of all parts, and the last part that replaces each id."""
    last = _last(spark, path)
    gone = spark.read.parquet(f"{path}/replaced").where(F.col("part") <= last).groupBy("id").agg(F.max("part").alias("from_part"))
    return spark.read.parquet(f"{path}/{kind}").where(F.col("part") <= last), gone


def texts(spark: SparkSession, path: str) -> DataFrame:
    """id, f, size: the texts that count."""
    rows, gone = _live(spark, path, "texts")
    return rows.join(gone, "id", "left").where("from_part is null or part >= from_part").select("id", "f", "size")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """trigram and id: what counts, one row each."""
    rows, gone = _live(spark, path, "postings")
    return rows.select("trigram", "part", F.explode("ids").alias("id")).join(gone, "id", "left").where("from_part is null or part >= from_part").select("trigram", "id")


def needed(n: Column) -> Column:
    """Words that a row must have: all of up to two, two thirds of more."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.floor(n * 2 / 3)))


def search(spark: SparkSession, path: str, searches: DataFrame, top: int = TOP) -> DataFrame:
    """search, id, found, whole, size: the rows that have enough of each search's words, best first; a word of one or two letters
    must stand alone. searches: search, texts of plain words. Words of three letters or more are answered from postings; a
    search that short words alone could satisfy goes over all texts."""
    own = searches.select("search", F.array_distinct(F.filter(F.split(F.lower("search"), "[^a-z0-9]+"), lambda x: x != "")).alias("words")).distinct()
    own = own.where(F.size("words") > 0).withColumn("enough", needed(F.size("words"))).withColumn("long", F.filter("words", lambda x: F.length(x) >= 3))
    own = own.withColumn("least", F.col("enough") - (F.size("words") - F.size("long")))
    asked = own.where("least >= 1").select("search", "least", F.explode("long").alias("word"))
    wanted = asked.select("search", "least", "word", F.explode(trigrams(F.col("word"))).alias("trigram")).withColumn("n", F.count("*").over(Window.partitionBy("search", "word")))
    rows, gone = _live(spark, path, "postings")
    # A few trigrams reach the scan as a filter; blocks of ids are intersected, a word at a time.
    met = F.broadcast(wanted).join(rows, "trigram") if searches.count() <= 1000 else wanted.join(rows, "trigram")
    both = met.groupBy("search", "least", "word", "n", "part", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("n"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), lambda x, y: F.array_intersect(x, y))
    held = both.select("search", "least", "part", F.explode(common).alias("id")).groupBy("search", "least", "part", "id").agg(F.count("*").alias("hits")).where("hits >= least")
    held = held.join(gone, "id", "left").where("from_part is null or part >= from_part").select("search", "id")
    live = texts(spark, path)
    # A word stands alone if it does between blanks once all but letters and digits are blanks: made once for a text.
    blanks = F.concat(F.lit(" "), F.regexp_replace("f", "[^a-z0-9]+", " "), F.lit(" ")).alias("g")
    rows = held.join(live, "id").join(own.select("search", "words", "enough"), "search").select("search", "id", "f", "size", "words", "enough", blanks)
    short = own.where("least < 1")
    if not short.isEmpty():
        rows = rows.unionByName(live.select("id", "f", "size", blanks).join(F.broadcast(short.select("search", "words", "enough"))).select(*rows.columns))
    alone = lambda w: F.contains("g", F.concat(F.lit(" "), w, F.lit(" ")))
    stands = F.size(F.filter("words", alone))
    found = F.size(F.filter("words", lambda w: F.when(F.length(w) <= 2, alone(w)).otherwise(F.contains("f", w))))
    rows = rows.select("search", "id", found.alias("found"), stands.alias("whole"), "size", "enough").where("found >= enough")
    place = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("found"), F.desc("whole"), "size", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("search", "id", "found", "whole", "size")
