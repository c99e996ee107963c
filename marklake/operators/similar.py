"""Similarity joins of names: the k most similar ones of each target, found by shared q-grams instead of all pairs.

Two names that differ by ``d`` edits share at least ``L + q - 1 - q * d`` of their padded
q-grams, ``L`` the longer length.  So a pair of at least similarity ``s`` (``d <= (1 - s) * L``)
must meet in the ``q * (1 - s) * length + 1`` rarest q-grams of each name: those alone are
joined, by equality.  The search goes down from high similarities with long q-grams to low
ones with short q-grams, and a target leaves it as soon as its k-th best name can't be beaten
by any that was not compared yet.

That one name holds the other is a search of its own: the shorter name's rarest trigram must
occur in the longer one, and such a pair's edit distance is the difference of the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

# (similarity, q), from high to low; with ``q * (1 - similarity) <= 1`` a pair shares at least one q-gram
ROUNDS = ((0.8, 4), (2 / 3, 3), (0.5, 2), (None, 1))
HELD = 0.5  # what a pair gains if one name holds the other
GRAM = 3


def _numbered(grams: Column) -> Column:
    """The grams of a text with the number of their occurrence, so that common ones are counted as often as they are shared."""
    return F.transform(F.array_sort(grams), lambda g, i: F.concat(g, F.lit("\u0000"), (i + 2 - F.array_position(F.array_sort(grams), g)).cast("string")))


def qgrams(text: Column, q: int) -> Column:
    """Numbered q-grams of a text padded on both sides."""
    padded = F.concat(F.lit("\u0001" * (q - 1)), text, F.lit("\u0002" * (q - 1)))
    return _numbered(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q))))


def _rarest(texts: DataFrame, common: DataFrame, grams: Column, keep: Column) -> DataFrame:
    """``s, g``: of every text ``s`` its ``keep`` rarest grams, by ``common (g, n)`` and then by themselves; grams that ``common`` lacks come first."""
    flat = texts.select("s", keep.alias("_keep"), F.explode(grams).alias("g")).join(common, "g", "left")
    listed = flat.groupBy("s", "_keep").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("gs"))
    return listed.select("s", F.explode(F.transform(F.slice("gs", F.lit(1), F.col("_keep")), lambda x: x["g"])).alias("g"))


def close_pairs(targets: DataFrame, names: DataFrame, similarity: float, q: int) -> DataFrame:
    """``target, name`` of all pairs of ``targets (s)`` and ``names (s)`` that may be at least so similar, each once.

    Both sides hold distinct texts of at least one character.
    """
    keep = F.floor(F.lit(q * (1 - similarity) + 1e-9) * F.length("s")).cast("int") + 1
    common = names.select(F.explode(qgrams(F.col("s"), q)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    a = _rarest(targets, common, qgrams(F.col("s"), q), keep).select(F.col("s").alias("target"), "g")
    b = _rarest(names, common, qgrams(F.col("s"), q), keep).select(F.col("s").alias("name"), "g")
    x, y = F.length("target"), F.length("name")
    return a.join(b, "g").where(F.least(x, y) >= F.lit(similarity - 1e-9) * F.greatest(x, y)).select("target", "name").distinct()


def held_pairs(targets: DataFrame, names: DataFrame) -> DataFrame:
    """``target, name`` of all pairs in which one text holds the other, equal ones too."""
    def spans(df: DataFrame, size: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.length("s") - (size - 1))
        return df.where(F.length("s") >= size).select("s", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("s"), i, F.lit(size))))).alias("g"))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        """``short, long``: by the rarest trigram of the short text; one of less than three characters is its own gram."""
        out = None
        for size in (1, 2, GRAM):
            grams = spans(long, size)
            if size < GRAM:
                keyed = short.where(F.length("s") == size).select(F.col("s").alias("short"), F.col("s").alias("g"))
            else:
                common = grams.groupBy("g").agg(F.count("*").alias("n"))
                rare = spans(short, size).join(common, "g").groupBy("s").agg(F.min(F.struct("n", "g")).alias("r"))
                keyed = rare.select(F.col("s").alias("short"), F.col("r.g").alias("g"))
            met = keyed.join(grams.select(F.col("s").alias("long"), "g"), "g").where(F.contains("long", F.col("short"))).select("short", "long")
            out = met if out is None else out.unionByName(met)
        return out

    below = inside(names, targets).select(F.col("long").alias("target"), F.col("short").alias("name"))
    above = inside(targets, names).select(F.col("short").alias("target"), F.col("long").alias("name"))
    return below.unionByName(above).distinct()


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each target by score, then name; tasks drop what can't be among them before the shuffle."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_similar(targets: DataFrame, names: DataFrame, k: int = 3, floor: float = 0.3) -> DataFrame:
    """``target, name, score, rank``: the ``k`` names of each target with the highest similarity above ``floor``.

    ``targets (target)`` and ``names (name)`` are made distinct.  The score is 1 less the
    edit distance over the longer length, and half a point more if one holds the other.
    An empty target is held by every name: its best are the first ones by name.
    """
    spark = targets.sparkSession
    work = Scratch(spark, "similar")
    t = work.save(targets.select(F.col("target").alias("s")).where("s IS NOT NULL").distinct(), "targets")
    n = work.save(names.select(F.col("name").alias("s")).where("s IS NOT NULL").distinct(), "names")
    full_t, full_n = t.where("s <> ''"), n.where("s <> ''")
    x, y = F.length("target"), F.length("name")
    near = 1 - F.abs(x - y) / F.greatest(x, y)
    found = best(held_pairs(full_t, full_n).withColumn("score", near + HELD), k).drop("rank")
    # the empty text is held by all: one row at most on the side that is broadcast, and the first k names for an empty target
    first = n.orderBy("s").limit(k)
    found = found.unionByName(full_t.join(F.broadcast(n.where("s = ''").withColumnRenamed("s", "name")), F.lit(True)).select(F.col("s").alias("target"), "name", F.lit(HELD).alias("score")))
    empty = F.broadcast(t.where("s = ''").withColumnRenamed("s", "target")).join(first, F.lit(True)).select("target", F.col("s").alias("name"), F.when(F.col("s") == "", 1.0 + HELD).otherwise(HELD).alias("score"))
    found = work.save(best(found.unionByName(empty), k).drop("rank"), "found-0")
    open_ = full_t
    for turn, (similarity, q) in enumerate(ROUNDS, 1):
        at = similarity or floor
        pairs = close_pairs(open_, full_n, at, q)
        d = F.levenshtein("target", "name")
        held = F.contains("target", F.col("name")) | F.contains("name", F.col("target"))
        score = 1 - d / F.greatest(x, y)
        scored = pairs.where(~held).withColumn("score", score).where((F.col("score") > floor) & (F.col("score") >= at - 1e-9))
        found = work.save(best(found.unionByName(scored).distinct(), k).drop("rank"), f"found-{turn}")
        # whatever was not compared lies below ``at``
        done = found.where(F.col("score") >= at).groupBy("target").count().where(F.col("count") >= k)
        open_ = work.save(open_.join(done.select(F.col("target").alias("s")), "s", "left_anti"), f"open-{turn}")
        if similarity is None or open_.isEmpty():
            break
    out = work.save(best(found.where(F.col("score") > floor), k).select("target", "name", "score", "rank"), "result")
    for name in ("targets", "names", *(f"{p}-{i}" for i in range(len(ROUNDS) + 1) for p in ("found", "open"))):
        work.drop(name)
    return out
