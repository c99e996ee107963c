"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a 60-bit hash.  Tokens are summed by source and leading hash
bits; the running sum over those buckets shows the bucket in which a source's
budget ends.  Only that bucket is split by the next bits, until it holds one
hash value.  A row is taken when its hash lies below its source's threshold, so
nothing is sorted and a larger budget always takes a superset of the rows of a
smaller one.

Defined results: a null text has size 0, a null source is a source of its own
(last), rows that are equal in ``id_col`` are taken or left together (rows without an
id if their texts are equal), an empty
table gives an empty result, and further columns of the input are kept as long
as their names differ from the new ones (those are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Workspace

WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 15  # hexadecimal digits of the md5 that make the hash: 60 bits
LEVEL_BITS = 12  # bits that one histogram resolves
BROADCAST_SOURCES = 100_000  # up to so many sources the threshold table is broadcast


def row_hash(id_col: Column, text_col: Column) -> Column:
    """60-bit hash of an id as text; a row without one is hashed by a line feed and its text."""
    named = F.coalesce(id_col.cast("string"), F.concat(F.lit("\n"), F.coalesce(text_col, F.lit(""))))
    hexes = F.substring(F.md5(named.cast("binary")), 1, HASH_DIGITS)
    return F.conv(hexes, 16, 10).cast("long")


def source_targets(sums: DataFrame, weights: list[float], max_repeat: float) -> DataFrame:
    """``target`` of each row of ``sums(source, source_size)``.

    Weights repeat over the sources in code-point order.  A target stops at
    ``max_repeat * source_size``; what is cut is shared among the others by weight.
    With sources ordered by the budget at which they fill up, the full ones are a
    prefix, so one running sum replaces the loop of resharing.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sums.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    df = df.withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    fills = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    df = df.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    df = df.withColumn("_level", F.col("_left") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    df = df.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    # the level of the first source that is not full holds for all sources that are not full
    first_open = F.min_by("_level", F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))).over(Window.partitionBy("_full"))
    df = df.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(first_open * F.col("_w")))
    return df.select("source", "source_size", "target")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_repeat: float = 3.0,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    A row is taken ``floor(target / source_size)`` times, and once more when its
    hash is below the threshold that spends the rest of its source's budget.
    """
    ws = Workspace(spark, "mix")
    docs = docs.drop("size", "source_size", "target", "taken")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = ws.save(docs.select(F.col(source_col).cast("string").alias("source"), row_hash(F.col(id_col), F.col(text_col)).alias("h"), size.alias("size")), "rows")

    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sums, list(weights), max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", F.least(whole, F.lit(int(max_repeat)).cast("long")))
    plan = ws.save(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    # (source, prefix of the boundary bucket, what may still be spent inside it)
    edge = plan.select("source", F.lit(0).cast("long").alias("prefix"), "budget")
    bits, total = 0, HASH_DIGITS * 4
    step = 0
    while bits < total:
        bits += LEVEL_BITS
        low = total - bits
        inside = rows.withColumn("prefix", F.shiftright("h", low + LEVEL_BITS)).alias("r").join(
            small(edge.alias("e")), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.prefix") == F.col("e.prefix"))
        )
        hist = inside.groupBy(F.col("e.source").alias("source"), F.col("e.budget").alias("budget"), F.shiftright(F.col("r.h"), low).alias("prefix")).agg(
            F.sum("r.size").alias("n"), F.min("r.h").alias("lo"), F.max("r.h").alias("hi")
        )
        run = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("cum", F.sum("n").over(run))
        # the boundary bucket: the first whose running sum passes the budget
        over = hist.where(F.col("cum") > F.col("budget"))
        edge = over.groupBy("source").agg(
            F.min_by(F.struct("prefix", (F.col("budget") - F.col("cum") + F.col("n")).alias("budget"), "n", "lo", "hi"), "prefix").alias("b")
        ).select("source", "b.*")
        step += 1
        edge = ws.save(edge, f"edge{step}")
        if edge.where(F.col("lo") < F.col("hi")).isEmpty():
            break
    # one hash value is left at the boundary: it is taken when that comes nearer to the budget
    ends = edge.select(F.col("source").alias("s"), F.when(F.col("budget") * 2 > F.col("n"), F.col("hi")).otherwise(F.col("lo") - 1).alias("threshold"))
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.coalesce("threshold", F.when(F.col("budget") > 0, (1 << 60)).otherwise(-1)).alias("_threshold")
    )
    plan = ws.settle(plan)  # a row for each source
    out = docs.withColumn("size", size).join(small(plan), F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    taken = F.col("_whole") + (row_hash(F.col(id_col), F.col(text_col)) <= F.col("_threshold")).cast("long")
    return out.withColumn("taken", F.col("size") * taken).drop("_source", "_whole", "_threshold")
