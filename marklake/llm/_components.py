"""Distributed connected components over an edge table; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace


HOT_PARTS = 1000  # a key with more than this part of all rows is hot, so there are fewer hot keys than that
PLAIN_ROWS = 1 << 22  # up to so many rows a plain join is as good, hot keys or not


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], times: str, total: int) -> DataFrame:
    """Inner join with ``right``, one row a key, where few keys may hold most rows of ``left``.

    ``times`` counts the rows of each key and ``total`` all of them.  The hot keys, at
    most ``HOT_PARTS``, are joined where their rows lie; only the others are shuffled.
    """
    if total <= PLAIN_ROWS:
        return left.join(right.drop(times), key)
    limit = total / HOT_PARTS
    hot, cold = right.where(F.col(times) > limit).drop(times), right.where(F.col(times) <= limit).drop(times)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key))


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(id, component)`` of every end of an edge ``(a, b)``; the component is its smallest id.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), which
    take a number of rounds in the order of the logarithm of the longest path.
    Each round is written out, so a lost executor costs one round at most.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before, turn = ws.save(pair, f"{name}-0"), None, 0
    size = now.count()
    while True:
        turn += 1
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("times"))
        large = join_hot(both.where("b > a"), least, "a", "times", 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, all point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))
        small = join_hot(large, low, "a", "times", 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        after = ws.save(small.where("a <> b").distinct(), f"{name}-{turn}")
        was, size = size, after.count()
        same = size == was and after.exceptAll(now).isEmpty()
        if before is not None:
            ws.drop(before)
        before = f"{name}-{turn - 1}"
        now = after
        if same:
            break
    ws.drop(before)
    star = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
