"""Access tokens: a table of principals, and its life cycle.  Times are always parameters."""

from __future__ import annotations

import secrets
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import TOKENS

SCOPES = ("read", "write", "admin")


def _prefix(p: str) -> str:
    if "\\" in p:
        raise ValueError(f"not a canonical path: {p}")
    parts = [x for x in p.split("/") if x not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"not a canonical path: {p}")
    return "/".join(parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TOKENS)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The token store of a JSON file; empty where it cannot be read."""
    try:
        df = spark.read.schema(TOKENS).json(path, multiLine=True)
        df.head(1)
        return df
    except Exception:
        return empty(spark)


def create(tokens: DataFrame, name: str, now: str, scopes: list[str] | None = None, path_allow: list[str] | None = None, path_deny: list[str] | None = None, expires_at: str | None = None) -> tuple[DataFrame, str, str]:
    """``(tokens, id, secret)``; the table holds the secret's SHA-256 only."""
    scopes = scopes or ["read"]
    if not name.strip() or any(s not in SCOPES for s in scopes):
        raise ValueError("a token needs a name and known scopes")
    if expires_at is not None:
        if date.fromisoformat(expires_at).isoformat() != expires_at or expires_at < now[:10]:
            raise ValueError("expires_at must be a real date that is not past")
    key, secret = secrets.token_hex(8), secrets.token_urlsafe(32)
    spark = tokens.sparkSession
    row = spark.createDataFrame([(key, name.strip(), scopes, [_prefix(p) for p in path_allow or []], [_prefix(p) for p in path_deny or []], expires_at)], "id string, name string, scopes array<string>, path_allow array<string>, path_deny array<string>, expires_at string")
    row = row.withColumn("hash", F.sha2(F.lit(secret), 256)).withColumn("created_at", F.lit(now).cast("timestamp"))
    return tokens.unionByName(row, allowMissingColumns=True), key, secret


def valid(tokens: DataFrame, today: str) -> DataFrame:
    """Tokens that are neither revoked nor expired; one is good through its last day."""
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= today)))


def authenticate(tokens: DataFrame, secret: str, today: str) -> DataFrame:
    return valid(tokens, today).where(F.col("hash") == F.sha2(F.lit(secret), 256))


def revoke(tokens: DataFrame, key: str, now: str) -> DataFrame:
    hit = (F.col("id") == key) & F.col("revoked_at").isNull()
    return tokens.withColumn("revoked_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("revoked_at")))


def touch(tokens: DataFrame, uses: DataFrame) -> DataFrame:
    """``last_used_at`` after ``uses (id, ts, ip)``: at most one change for each minute."""
    last = uses.groupBy("id", F.date_trunc("minute", "ts").alias("minute")).agg(F.min_by(F.struct("ts", "ip"), "ts").alias("u"))
    last = last.groupBy("id").agg(F.max("u").alias("u"))
    joined = tokens.join(last, "id", "left")
    newer = F.col("u").isNotNull() & (F.col("last_used_at").isNull() | (F.date_trunc("minute", "last_used_at") < F.date_trunc("minute", F.col("u.ts"))))
    out = joined.withColumn("last_used_ip", F.when(newer, F.col("u.ip")).otherwise(F.col("last_used_ip")))
    return out.withColumn("last_used_at", F.when(newer, F.col("u.ts")).otherwise(F.col("last_used_at"))).select(*tokens.columns)


def public(tokens: DataFrame, today: str) -> DataFrame:
    """Tokens without their hash, with ``expired``."""
    return tokens.drop("hash").withColumn("expired", F.coalesce(F.col("expires_at") < today, F.lit(False)))


def active_count(tokens: DataFrame, today: str) -> DataFrame:
    return valid(tokens, today).agg(F.count("*").alias("active"))


def real_date(value):
    return T.is_real_date(value)
