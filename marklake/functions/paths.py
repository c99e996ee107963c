"""Path algebra and row-level access predicates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """Path without empty and ``.`` parts, ``..`` resolved; null with a backslash or above the root.

    Only paths that hold such a part are folded; all others are canonical as they stand.
    """
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("bad"))

    def step(acc, x):
        up = x == ".."
        out = F.when(up, F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(x)))
        return F.struct(out.alias("out"), (acc["bad"] | (up & (F.size(acc["out"]) == 0))).alias("bad"))

    folded = F.aggregate(parts, start, step)
    folded = F.when(~F.contains(path, F.lit("\\")) & ~folded["bad"], F.array_join(folded["out"], "/"))
    return F.when(~F.rlike(path, F.lit(r"\\|(?:\A|/)\.{0,2}(?:/|\z)")), path).otherwise(folded)


def canonical_text(path: str) -> str | None:
    """The same for a value."""
    out: list[str] = []
    for part in path.split("/"):
        if "\\" in part or (part == ".." and not out):
            return None
        if part == "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def under(path: Column, prefix: Column) -> Column:
    """``path`` is ``prefix`` or lies below it, by whole parts; the empty prefix covers all, an uncanonical side nothing."""
    p, q = canonical(path), canonical(prefix)
    return F.coalesce((q == "") | (p == q) | F.startswith(p, F.concat(q, F.lit("/"))), F.lit(False)) & p.isNotNull()


def _below(p: Column, prefixes: list[str]) -> Column:
    """The canonical path lies at or below one of the prefixes."""
    out = F.lit(False)
    for q in map(canonical_text, prefixes):
        if q is not None:
            out = out | (F.lit(True) if q == "" else (p == q) | F.startswith(p, F.lit(q + "/")))
    return out


def _above(p: Column, prefixes: list[str]) -> Column:
    """One of the prefixes lies at or below the canonical path."""
    out = F.lit(False)
    for q in map(canonical_text, prefixes):
        if q is not None:
            out = out | (p == "") | (p == q) | F.startswith(F.lit(q), F.concat(p, F.lit("/")))
    return out


def _accepted(path: Column, test) -> Column:
    """``test`` of the canonical path, which is made once a row; paths without a canonical form fail."""
    return F.coalesce(F.exists(F.array(canonical(path)), lambda p: p.isNotNull() & test(p)), F.lit(False))


def can_access_file(path: Column, allow: list[str], deny: list[str]) -> Column:
    """Deny wins; without an allow list all else passes."""
    return _accepted(path, lambda p: ~_below(p, deny) & (_below(p, allow) if allow else F.lit(True)))


def can_access_path(path: Column, allow: list[str], deny: list[str]) -> Column:
    """For browsing: folders above an allowed prefix pass as well."""
    return _accepted(path, lambda p: ~_below(p, deny) & (_below(p, allow) | _above(p, allow) if allow else F.lit(True)))


def can_access_tree(path: Column, allow: list[str], deny: list[str]) -> Column:
    """For whole folders: nothing denied above or below; a folder above an allowed prefix does not pass."""
    return _accepted(path, lambda p: ~_below(p, deny) & ~_above(p, deny) & (_below(p, allow) if allow else F.lit(True)))


def has_scope(scopes: Column, wanted: str) -> Column:
    """admin covers write covers read."""
    order = ("read", "write", "admin")
    return F.arrays_overlap(scopes, F.array(*[F.lit(s) for s in order[order.index(wanted) :]]))


_WILD = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}  # what a glob's wild parts stand for


def glob_regex(glob: str | None) -> str:
    """Regular expression of a folder glob; a glob without ``**`` covers what lies below it."""
    folder = (glob or "").strip().replace("\\", "/").strip("/")
    if "**" not in folder:
        folder = f"{folder}/**" if folder else "**"
    pieces = re.split(r"(\*\*/?|[*?])", folder)
    return r"\A" + "".join(_WILD.get(x, rf"\Q{x}\E" if x else "") for x in pieces) + r"\z"


def private_v4(host: Column) -> Column:
    """Dotted addresses of private, loopback, link-local, shared and unspecified ranges; null for other text."""
    octet = [F.regexp_extract(host, r"\A(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z", i).try_cast("int") for i in range(1, 5)]
    a, b = octet[0], octet[1]
    inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    return F.when(octet[3].isNotNull(), inside)


def is_private_host(host: Column) -> Column:
    """Private IPv4 or IPv6 literal, mapped IPv4 included."""
    h = F.lower(F.regexp_replace(host, r"\A\[|\]\z", ""))
    v6 = F.contains(h, F.lit(":"))
    mapped = F.regexp_extract(h, r"\A::ffff:(\d+\.\d+\.\d+\.\d+)\z", 1)
    inside = h.isin("::", "::1") | F.startswith(h, F.lit("fe80")) | F.startswith(h, F.lit("fc")) | F.startswith(h, F.lit("fd")) | F.coalesce(private_v4(mapped), F.lit(False))
    return F.when(v6, inside).otherwise(F.coalesce(private_v4(h), F.lit(False)))


def url_allowed(url: Column) -> Column:
    """https, a host, and neither localhost nor a private address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & host.isNotNull() & (host != "localhost") & ~F.endswith(host, F.lit(".localhost")) & ~is_private_host(host), F.lit(False))
