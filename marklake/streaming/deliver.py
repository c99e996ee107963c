"""Delivery of matched changes, at least once, with a transport that the caller supplies."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import json
import socket
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES, TIMEOUT, AT_ONCE = 3, 10.0, 5
REPORT = "webhook_id string, path string, event string, status int, tries int, error string, key string"


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def signature_of(secret: Column, body: Column) -> Column:
    """The same for columns of secrets and bodies (binary); null where one of them is."""
    def work(keys: pa.Array, bodies: pa.Array) -> pa.Array:
        made = (None if k is None or b is None else "sha256=" + hmac.digest(k, b, "sha256").hex() for k, b in zip(keys.to_pylist(), bodies.to_pylist()))
        return pa.array(made, pa.string())

    return F.arrow_udf(work, "string")(secret.cast("binary"), body.cast("binary"))


def public_address(url: str, resolve: Callable = socket.getaddrinfo) -> bool:
    """Whether every address that the host has at this moment is public."""
    host = urlsplit(url).hostname
    if not host:
        return False
    try:
        found = {x[4][0].split("%")[0] for x in resolve(host, None)}
    except OSError:
        return False
    plain = [ipaddress.ip_address(a) for a in found]
    return bool(plain) and all((a.ipv4_mapped or a if a.version == 6 else a).is_global for a in plain)


def send(transport: Callable[[str, bytes, dict, float], int], url: str, body: bytes, headers: dict, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, guard: Callable[[str], bool] | None = None) -> tuple[int | None, int, str | None]:
    """``(status, tries, error)``: network failures, 429 and 5xx are tried again after 1, 2, ... seconds; other answers are final.

    ``guard`` tests the address before each attempt, since what a name stands for may change between them.
    """
    status, error = None, None
    for turn in range(1, tries + 1):
        if guard and not guard(url):
            return None, turn - 1, "address refused"
        try:
            status, error = transport(url, body, headers, TIMEOUT), None
        except Exception as e:
            status, error = None, str(e)
        if status is not None and status != 429 and status < 500:
            return status, turn, None if status < 300 else f"HTTP {status}"
        if turn < tries:
            sleep(2.0 ** (turn - 1))
    return status, tries, error or f"HTTP {status}"


def deliver(matched: DataFrame, transport: Callable, at_once: int = AT_ONCE, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, guard: Callable[[str], bool] | None = None) -> DataFrame:
    """Send every row of ``matched`` (see ``webhooks.match``); ``at_once`` partitions bound what is in flight.

    ``guard`` (such as :func:`public_address`) tests each address just before it is used.
    A ``key`` of the rows is handed on.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                payload = {"event": r.event, "path": r.path, "frontmatter": json.loads(r.frontmatter or "{}"), "timestamp": pd.Timestamp(r.ts).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "webhook_id": r.webhook_id}
                if r.body is not None:
                    payload["body"] = r.body
                body = json.dumps(payload, ensure_ascii=False).encode()
                headers = {"Content-Type": "application/json"} | ({"X-Signature": signature(r.secret, body)} if r.secret else {})
                rows.append((r.webhook_id, r.path, r.event, *send(transport, r.url, body, headers, tries, sleep, guard), getattr(r, "key", None)))
            yield pd.DataFrame(rows, columns=["webhook_id", "path", "event", "status", "tries", "error", "key"]).astype({"status": "Int32", "tries": "int32"})

    return matched.repartition(at_once).mapInPandas(work, REPORT)


def test_delivery(rules: DataFrame, key: str, transport: Callable, now: str, guard: Callable[[str], bool] | None = None) -> tuple[int | None, int, str | None]:
    """Send one rule a sample change, once: ``(status, tries, error)``."""
    rule = rules.where(rules["id"] == key).select("url", "secret").head()
    if rule is None:
        raise KeyError(key)
    if guard and not guard(rule.url):
        return None, 0, "address refused"
    body = json.dumps({"event": "test", "path": "test.md", "frontmatter": {}, "timestamp": now, "webhook_id": key}).encode()
    headers = {"Content-Type": "application/json"} | ({"X-Signature": signature(rule.secret, body)} if rule.secret else {})
    return send(transport, rule.url, body, headers, tries=1)


test_delivery.__test__ = False  # an operation, not a test
