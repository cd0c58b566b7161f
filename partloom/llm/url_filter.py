"""URL filters as a temporal list join, in DataFrame functions alone.

A list is a log of dated entries: from `since` on, `scope` is blocked, allowed or cleared. The
entries of a scope become validity intervals, each up to the next one's date. A scope is a domain
(`example.com`, which covers its subdomains) or a host with a path's first segments
(`www.example.com/en`). A capture is judged as of its fetch time by the longest of its scopes that
has an interval then: an as-of join on the scope and the month, so that neither a scope with a long
history nor one with very many captures meets all against all.

Defined results: a capture without a host or a time matches nothing and is allowed; host names are
compared in lower case, without user, port and a final dot. Of entries for one scope at one time,
block outranks allow, and allow outranks clear. Entries without scope, date or a known action are
skipped. Repeated captures give repeated results; empty tables give no rows, or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.base import prepare

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ACTIONS = {"clear": 0, "allow": 1, "block": 2}


def host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def scopes(url: Column, depth: int = 2) -> Column:
    """All scopes of a URL: the host, its parent domains of two labels or more, and the host with up to `depth` path segments."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    count = F.least(F.size(parts), F.lit(depth))
    paths = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(parents, paths)))


def intervals(entries: DataFrame, scope: str = "scope", since: str = "since", action: str = "action") -> DataFrame:
    """scope, action, begins, ends (null: open). One row per scope and date, of the action that outranks the others."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col(action))
    named = entries.select(F.lower(F.col(scope)).alias("scope"), F.col(since).cast("timestamp").alias("begins"), F.when(F.col(action).isin(*ACTIONS), rank).alias("rank"))
    one = named.where("scope is not null and begins is not null and rank is not null").groupBy("scope", "begins").agg(F.max("rank").alias("rank"))
    ends = F.lead("begins").over(Window.partitionBy("scope").orderBy("begins"))
    names = F.array(*[F.lit(x) for x in ACTIONS])
    return one.select("scope", "begins", ends.alias("ends"), F.element_at(names, F.col("rank") + 1).alias("action"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", depth: int = 2) -> DataFrame:
    """captures with rule_scope and rule_since of the entry that decides (null: none) and blocked. Names that captures
    has already are replaced."""
    prepare(captures.sparkSession)
    columns = [c for c in captures.columns if c.lower() not in ("rule_scope", "rule_since", "blocked")]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{url}`").alias("u"), F.col(f"`{fetched}`").cast("timestamp").alias("t"))
    once = rows.where("u is not null and t is not null").select("u", "t").distinct()
    asked = once.select("u", "t", F.explode(scopes(F.col("u"), depth)).alias("scope"), F.trunc("t", "month").alias("month"))
    span = once.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    valid = intervals(entries)
    if span.lo is not None:
        upto = F.least(F.coalesce("ends", F.lit(span.hi)), F.lit(span.hi))
        start = F.greatest("begins", F.lit(span.lo))
        valid = valid.where(start <= upto).withColumn("month", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(upto, "month"), F.expr("interval 1 month"))))
    else:
        valid = valid.withColumn("month", F.trunc("begins", "month")).limit(0)
    held = asked.join(valid, ["scope", "month"]).where((F.col("begins") <= F.col("t")) & (F.col("ends").isNull() | (F.col("t") < F.col("ends"))) & (F.col("action") != "clear"))
    best = held.groupBy("u", "t").agg(F.max_by(F.struct("scope", "begins", "action"), F.struct(F.length("scope"), "scope")).alias("rule"))
    out = rows.join(best, ["u", "t"], "left")
    return out.select("row.*", F.col("rule.scope").alias("rule_scope"), F.col("rule.begins").alias("rule_since"), F.coalesce(F.col("rule.action") == "block", F.lit(False)).alias("blocked"))
