"""What a caller may do: the scope that an operation needs, and its targets tested before it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

READS = ("list", "read", "batch_read", "search", "links", "check_links", "query", "directory", "projects", "status")
ADMIN = ("create_token", "list_tokens", "revoke_token", "create_rule", "update_rule", "delete_rule", "test_rule", "list_rules")
TREES = ("delete_folders", "move_folder")
BROWSE = ("directory", "projects")


class Denied(PermissionError):
    pass


def needed_scope(operation: str) -> str:
    return "admin" if operation in ADMIN else "read" if operation in READS else "write"


def allowed(calls: DataFrame, principal: dict) -> DataFrame:
    """``calls (operation, targets, ...)`` with ``allowed``: the scope suffices and every target is in reach; for batches of calls."""
    order = ("read", "write", "admin")
    held = max((order.index(s) for s in principal["scopes"] if s in order), default=-1)
    allow, deny = list(principal.get("path_allow") or []), list(principal.get("path_deny") or [])
    operation = F.col("operation")
    need = F.when(operation.isin(*ADMIN), 2).when(operation.isin(*READS), 0).otherwise(1)
    every = lambda test: F.forall(F.coalesce("targets", F.array().cast("array<string>")), lambda t: test(t, allow, deny))
    reach = F.when(operation.isin(*TREES), every(P.can_access_tree)).when(operation.isin(*BROWSE), every(P.can_access_path)).otherwise(every(P.can_access_file))
    closed = (operation == "query") & F.lit(bool(allow or deny))
    return calls.withColumn("allowed", (need <= held) & reach & ~closed)


def require(spark: SparkSession, principal: dict, operation: str, targets: list[str] = ()) -> None:
    """Refuse the whole operation if the scope is missing or any one target is out of reach."""
    order = ("read", "write", "admin")
    if not set(principal["scopes"]) & set(order[order.index(needed_scope(operation)) :]):
        raise Denied(f"{operation} needs the scope {needed_scope(operation)}")
    allow, deny = list(principal.get("path_allow") or []), list(principal.get("path_deny") or [])
    if operation == "query" and (allow or deny):
        raise Denied("queries see whole tables and are closed to callers with path limits")
    if not targets:
        return
    test = P.can_access_tree if operation in TREES else P.can_access_path if operation in BROWSE else P.can_access_file
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    bad = df.where(~test(F.col("t"), allow, deny)).head(1)
    if bad:
        raise Denied(f"no access to {bad[0].t}")


def visible_classes(notes: DataFrame, callers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class, path)`` and ``(id, class)``: callers with the same prefixes are one class, whose notes are found once.

    A path is equi-joined by the folders above it (and by itself) with a table of all
    classes' prefixes; a denied prefix wins over an allowed one, and a caller without an
    allow list may see all else.  Paths and prefixes without a canonical form fit nothing.
    """
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    allow, deny = listed(F.col("path_allow")), listed(F.col("path_deny"))
    every = F.when(F.size(allow) == 0, F.array(F.lit(""))).otherwise(allow)
    sides = F.concat(F.transform(every, lambda p: F.struct(p.alias("p"), F.lit(True).alias("ok"))), F.transform(deny, lambda p: F.struct(p.alias("p"), F.lit(False).alias("ok"))))
    each = callers.select("id", F.inline(sides)).select("id", F.struct(P.canonical(F.col("p")).alias("_above"), "ok").alias("side")).where("side._above IS NOT NULL")
    held = each.groupBy("id").agg(F.array_sort(F.collect_set("side")).alias("sides"))  # one caller's own list
    members = held.select("id", F.sha2(F.to_json("sides").cast("binary"), 256).alias("class"), "sides")
    prefixes = members.groupBy("class").agg(F.first("sides").alias("sides")).select("class", F.inline("sides"))
    parts = F.split("_canonical", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = notes.select("path", P.canonical(F.col("path")).alias("_canonical")).where("_canonical IS NOT NULL").distinct().select("path", F.explode(F.array_distinct(above)).alias("_above"))
    met = paths.join(prefixes, "_above").groupBy("class", "path").agg(F.bool_and("ok").alias("ok"))
    return met.where("ok").select("class", "path"), members.select("id", "class")


def visible(notes: DataFrame, callers: DataFrame) -> DataFrame:
    """``id, path``: the notes that each of ``callers (id, path_allow, path_deny)`` may see, for all callers in one plan; what needs no row for each pair asks :func:`visible_classes`."""
    seen, members = visible_classes(notes, callers)
    return seen.join(members, "class").select("id", "path")
