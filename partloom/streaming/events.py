"""Streaming forms of the event operators: windows, duplicates, joins in time, inbox state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def demand(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches, failed searches and sales by window; rows later than `late` are left out. events: ts, event_type."""
    t = F.col("event_type")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"))
        .agg(F.count_if(t.isin("view", "click")).alias("searches"), F.count_if(t == "error").alias("failed"), F.count_if(t == "purchase").alias("sales"))
        .select(F.col("w.start").alias("start"), "searches", "failed", "sales")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def search_to_sale(searches: DataFrame, sales: DataFrame, minutes: int = 20) -> DataFrame:
    """Stream join of searches with the same user's sales within minutes. Both: user_id, ts, code."""
    a = searches.select(F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("asked"), F.col("code").alias("asked_code")).withWatermark("asked", "5 minutes")
    b = sales.select(F.col("user_id").alias("v"), F.col("ts").cast("timestamp").alias("sold"), F.col("code").alias("sold_code")).withWatermark("sold", "5 minutes")
    near = F.expr(f"u = v and sold >= asked and sold <= asked + interval {minutes} minutes and asked_code <> sold_code")
    return a.join(b, near).select(F.col("u").alias("user_id"), "asked_code", "sold_code", "asked", "sold")


def attempts(events: DataFrame, most: int, size: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    """Users with more than `most` failed searches in a sliding window."""
    failed = events.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", step)
    g = failed.groupBy(F.window("ts", size, step).alias("w"), "user_id").agg(F.count("*").alias("attempts"))
    return g.where(F.col("attempts") > most).select("user_id", F.col("w.start").alias("start"), "attempts")


def inbox(messages: DataFrame) -> DataFrame:
    """Per conversation, kept as state: turns seen and user turns since the last answer. messages: conv_id, turn, role."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turns, waiting, last = state.get if state.exists else (0, 0, -1)
        for frame in frames:
            for turn, role in sorted(zip(frame["turn"].tolist(), frame["role"].tolist())):
                if turn <= last:
                    continue  # delivered before
                turns, last = turns + 1, turn
                waiting = 0 if role == "assistant" else waiting + (role == "user")
        state.update((turns, waiting, last))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "waiting": [waiting]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, waiting long", "turns long, waiting long, last long", "update", "NoTimeout")
