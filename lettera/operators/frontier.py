"""The crawl frontier as a DataFrame: insert or ignore, claim, finish, requeue, and the wave loop over them.

Columns: url, depth, priority, state, discovered_from, attempts, seq. States go
pending, active, then done, failed or skipped; a restart makes active rows pending again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "url string, depth int, priority int, state string, discovered_from string, attempts int, seq long"


def add_urls(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """frontier with the URLs of found (url, depth, priority, discovered_from, seq) that it lacks; of a repeated URL the first by seq counts."""
    first = found.groupBy("url").agg(F.min_by(F.struct("depth", "priority", "discovered_from", "seq"), "seq").alias("r"))
    new = first.join(frontier.select("url"), "url", "left_anti")
    return frontier.unionByName(new.select("url", "r.depth", "r.priority", F.lit("pending").alias("state"), "r.discovered_from", F.lit(0).alias("attempts"), "r.seq"))


def top_pending(frontier: DataFrame, limit: int) -> DataFrame:
    return frontier.where("state = 'pending'").orderBy(F.desc("priority"), "depth", "seq").limit(limit)


def claim(frontier: DataFrame, limit: int) -> DataFrame:
    """frontier with the next `limit` pending rows active and one attempt more."""
    taken = F.broadcast(top_pending(frontier, limit).select("url", F.lit(True).alias("_taken")))  # `limit` rows
    rows = frontier.join(taken, "url", "left")
    return rows.withColumns({"state": F.when(F.col("_taken"), "active").otherwise(F.col("state")), "attempts": F.col("attempts") + F.when(F.col("_taken"), 1).otherwise(0)}).drop("_taken").select(frontier.columns)


def finish(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """frontier with the states of results (url, result)."""
    return frontier.join(results.groupBy("url").agg(F.max("result").alias("result")), "url", "left").withColumn("state", F.coalesce("result", "state")).select(frontier.columns)


def requeue_active(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("state", F.when(F.col("state") == "active", "pending").otherwise(F.col("state")))


def counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("state").agg(F.count("*").alias("n"))


def crawl(frontier: DataFrame, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], keep: Callable[[DataFrame, int], DataFrame], wave: int = 4, max_depth: int = 12, max_waves: int = 1000) -> DataFrame:
    """Waves until nothing is pending: claim, process, finish, enqueue. The driver sees one count a wave.

    process(claimed) gives (results (url, result), links (url, discovered_from, depth, priority, seq)); keep(frontier, wave number) writes
    the frontier and gives it as read back, so a wave never recomputes those before it and a restart goes on from the last one.
    """
    frontier = keep(requeue_active(frontier), 0)
    for n in range(1, max_waves + 1):
        frontier = keep(claim(frontier, wave), 2 * n - 1)
        active = frontier.where("state = 'active'")
        if active.isEmpty():
            break
        deep = active.where(F.col("depth") > max_depth).select("url", F.lit("skipped").alias("result"))
        results, links = process(active.where(F.col("depth") <= max_depth))
        frontier = keep(add_urls(finish(frontier, results.unionByName(deep)), links), 2 * n)
    return frontier
