"""Change rules: which of them a change event meets, and the rule table."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.yaml import field_matches, field_values
from ..schema import RULES

EVENTS = ("add", "change", "unlink")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULES)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rule store of a JSON file; empty where it cannot be read."""
    try:
        df = spark.read.schema(RULES).json(path, multiLine=True)
        df.head(1)
        return df
    except Exception:
        return empty(spark)


def _globs(rules: DataFrame) -> DataFrame:
    """``rules`` with ``_glob`` (regular expression of the folder) and ``_prefix`` (its folders before the first wild one), as ``paths.glob_regex`` reads them."""
    folder = F.regexp_replace(F.replace(F.trim(F.coalesce("folder", F.lit(""))), F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")
    folder = F.when(F.contains(folder, F.lit("**")), folder).when(folder == "", "**").otherwise(F.concat(folder, F.lit("/**")))
    plain = F.regexp_replace(folder, r"[\\\[\](){}.+^$|]", r"\\$0")
    deep = F.regexp_replace(plain, r"\*\*/?", "\u0001")
    wild = F.replace(F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit(".*"))
    return rules.withColumn("_glob", F.concat(F.lit(r"\A"), wild, F.lit(r"\z"))).withColumn("_prefix", F.regexp_replace(F.regexp_extract(folder, r"\A((?:[^/*?]+/)*)", 1), r"/\z", ""))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Enabled rules with the condition that finds them: ``_prefix``, and the front-matter pair that the fewest rules ask for (null without one).

    A pair with an empty value also holds for notes without the field, so it is no key.
    """
    on = _globs(rules.where("enabled"))
    asked = on.select("id", F.explode(F.map_entries("frontmatter")).alias("p")).where("p.value <> ''").select("id", pair("p.key", "p.value").alias("pair"))
    rare = asked.join(asked.groupBy("pair").agg(F.count("*").alias("n")), "pair").groupBy("id").agg(F.min_by("pair", F.struct("n", "pair")).alias("_pair"))
    return on.join(rare, "id", "left")


def pair(key: str, value: str) -> Column:
    return F.concat(F.col(key), F.lit("\u0001"), F.col(value))


def event_keys(events: DataFrame) -> DataFrame:
    """``events`` once for every folder above the path and, in each, once without and once with every value of the front matter."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    values = F.transform(F.map_entries("_fm"), lambda e: F.transform(field_values(e["value"]), lambda v: F.concat(e["key"], F.lit("\u0001"), v)))
    pairs = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.flatten(values)))
    return events.withColumn("_above", F.explode(F.array_distinct(above))).withColumn("_pair", F.explode(pairs))


def match(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``events (event, path, frontmatter, ts[, content])`` joined with every enabled rule that they meet, as payload rows.

    Rules are a table of any size.  Each is found by an equi-join on one of its conditions,
    its literal folder with its rarest front-matter pair; how many of its other pairs hold
    is counted on what was found, and its glob is tested last.
    """
    body = F.col("content") if "content" in events.columns else F.lit(None).cast("string")
    fm = F.coalesce(F.from_json("frontmatter", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    keyed = event_keys(events.select("event", "path", "frontmatter", "ts", body.alias("_content"), fm.alias("_fm")))
    hooks = rule_keys(rules).select("id", "url", "secret", "include_body", "events", F.col("frontmatter").alias("_is"), F.col("frontmatter_not").alias("_not"), "_glob", F.col("_prefix").alias("_above"), "_pair")
    found = keyed.join(hooks, (keyed["_above"] == hooks["_above"]) & keyed["_pair"].eqNullSafe(hooks["_pair"])).drop("_above", "_pair")
    holds = lambda e: field_matches(F.try_element_at("_fm", e["key"]), e["value"])
    conditions = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
    met = lambda c: F.size(F.filter(conditions(c), holds))
    asked = F.coalesce(F.size("events"), F.lit(0)) > 0
    wanted = F.when(asked, F.array_contains("events", F.col("event"))).otherwise(F.col("event").isin(*EVENTS))
    ok = wanted & (met("_is") == F.size(conditions("_is"))) & (met("_not") == 0) & F.rlike("path", F.col("_glob"))
    return found.where(ok).select("event", "path", "frontmatter", "ts", F.col("id").alias("webhook_id"), "url", "secret", F.when(F.col("include_body"), F.col("_content")).alias("body"))


def match_classes(events: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(event, path, frontmatter, ts, class)`` and ``(id, class)``: enabled rules with the same conditions are one class, which an event meets once.

    Every pair of :func:`match` is a pair of the first table with a member of its class.
    """
    entries = lambda c: F.coalesce(F.array_sort(F.map_entries(c)), F.array().cast("array<struct<key:string,value:string>>"))
    asked = F.array_sort(F.array_distinct(F.coalesce("events", F.array().cast("array<string>"))))
    same = F.to_json(F.struct(F.coalesce("folder", F.lit("")).alias("f"), entries("frontmatter").alias("i"), entries("frontmatter_not").alias("n"), asked.alias("e")), {"ignoreNullFields": "false"})
    classed = rules.where("enabled").withColumn("class", F.sha2(same.cast("binary"), 256))
    one = classed.dropDuplicates(["class"]).withColumns({"id": F.col("class"), "url": F.lit(None).cast("string"), "secret": F.lit(None).cast("string"), "include_body": F.lit(False)})
    met = match(events.select("event", "path", "frontmatter", "ts"), one.drop("class"))
    return met.select("event", "path", "frontmatter", "ts", F.col("webhook_id").alias("class")), classed.select("id", "class")


def create(rules: DataFrame, url: str, now: str, *, name: str = "", folder: str = "", frontmatter: dict | None = None, frontmatter_not: dict | None = None, events: list[str] | None = None, secret: str | None = None, include_body: bool = False, allow_private: bool = False, key: str | None = None) -> DataFrame:
    """The rules with one more; its address must be public unless ``allow_private``."""
    chosen = list(dict.fromkeys(events or EVENTS))
    if any(e not in EVENTS for e in chosen):
        raise ValueError("unknown event")
    spark = rules.sparkSession
    if not allow_private and not spark.range(1).select(P.url_allowed(F.lit(url))).first()[0]:
        raise ValueError("the address must be https and public")
    key = key or secrets.token_hex(8)
    row = spark.createDataFrame([(key, True, url, name, folder, frontmatter or {}, frontmatter_not or {}, chosen, secret, include_body)], "id string, enabled boolean, url string, name string, folder string, frontmatter map<string,string>, frontmatter_not map<string,string>, events array<string>, secret string, include_body boolean")
    stamp = F.lit(now).cast("timestamp")
    return rules.unionByName(row.withColumn("created", stamp).withColumn("updated", stamp))


def update(rules: DataFrame, key: str, now: str, **fields) -> DataFrame:
    """Only the given fields of one rule change."""
    kinds = dict(rules.dtypes)
    out, hit = rules, F.col("id") == key
    for name, value in {**fields, "updated": now}.items():
        new = F.lit(value) if not isinstance(value, dict) else F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
        out = out.withColumn(name, F.when(hit, new.cast(kinds[name])).otherwise(F.col(name)))
    return out


def remove(rules: DataFrame, key: str) -> DataFrame:
    return rules.where(F.col("id") != key)


def public(rules: DataFrame) -> DataFrame:
    """Rules without their secret, with ``has_secret``."""
    return rules.withColumn("has_secret", F.coalesce(F.col("secret") != "", F.lit(False))).drop("secret")
