"""Wikilinks: resolution against the note names, and suggestions for broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import similar


def edges(notes: DataFrame, content_col: str = "content") -> DataFrame:
    """``src, pos, raw, target`` of all links of ``notes (path, content)``."""
    return notes.select(F.col("path").alias("src"), F.posexplode(T.link_targets(F.col(content_col))).alias("pos", "l")).select("src", "pos", "l.raw", "l.target")


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` with ``exists, resolved, ambiguous``: by the whole path first, else by the last part of the target.

    Both lookups are equi-joins on folded names, so they run on any number of notes;
    of several notes of one name the smallest path is taken, and all are listed.
    """
    by_path = notes.select(F.regexp_replace(F.lower("path"), r"\.md\z", "").alias("full"), F.col("path").alias("hit")).groupBy("full").agg(F.min("hit").alias("hit"))
    named = notes.select(F.lower(T.basename(F.col("path"))).alias("name"), "path")
    target = F.regexp_replace(F.lower("target"), r"\.md\z", "")
    keyed = links.withColumn("_full", target).withColumn("_name", F.element_at(F.split(target, "/"), -1))
    # paths are listed only for names that some link asks for; of all others the smallest is enough
    asked = keyed.select(F.col("_name").alias("name")).distinct()
    by_name = named.join(asked, "name", "left_semi").groupBy("name").agg(F.min("path").alias("least"), F.sort_array(F.collect_list("path")).alias("paths"))
    joined = keyed.join(by_path, F.col("_full") == F.col("full"), "left").join(by_name, F.col("_name") == F.col("name"), "left")
    resolved = F.coalesce("hit", "least")
    ambiguous = F.when(F.col("hit").isNull() & (F.size("paths") > 1), F.col("paths"))
    return joined.select(*links.columns, resolved.isNotNull().alias("exists"), resolved.alias("resolved"), ambiguous.alias("ambiguous"))


def of_text(spark: SparkSession, text: str, notes: DataFrame) -> DataFrame:
    """The links of one text, resolved against ``notes``."""
    one = spark.createDataFrame([("", text)], "path string, content string")
    return resolve(edges(one), notes).drop("src")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, and half a point more if one holds the other."""
    longest = F.greatest(F.length(a), F.length(b))
    close = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
    return close + F.when(F.contains(a, b) | F.contains(b, a), 0.5).otherwise(0.0)


def suggest(broken: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """``target, name, score, rank``: the ``k`` most similar ``names (name)`` for each distinct broken target, of more than 0.3, without case."""
    return similar.top_similar(broken.select(F.lower("target").alias("target")), names.select(F.lower("name").alias("name")), k)


def summary(resolved: DataFrame) -> DataFrame:
    """``src, count, broken_count``."""
    return resolved.groupBy("src").agg(F.count("*").alias("count"), F.count_if(~F.col("exists")).alias("broken_count"))
