"""YAML front matter to JSON and back, in Arrow batches.

Scalars follow YAML 1.2's core schema as far as notes use it: only ``true`` and
``false`` are booleans, colons make no sexagesimal numbers, and dates become ISO
instants in UTC.
"""

from __future__ import annotations

import datetime as dt
import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


_Fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the C parser where it was built in


class _Loader(_Fast):
    pass


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?[0-9]+|0x[0-9a-fA-F]+|0o[0-7]+)$"), list("-+0123456789"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][-+]?[0-9]+)?$|^[-+]?[0-9]+[eE][-+]?[0-9]+$"), list("-+0123456789."))


def _integer(loader, node):
    s = loader.construct_scalar(node).replace("_", "")
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("+-")
    return sign * int(s, 16 if s.lower().startswith("0x") else 8 if s.lower().startswith("0o") else 10)


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)


def _plain(value):
    if isinstance(value, dt.datetime):
        value = value.astimezone(dt.UTC) if value.tzinfo else value
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, dt.date):
        return f"{value.isoformat()}T00:00:00.000Z"
    if isinstance(value, dict):
        return {str(_plain(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return value


# A line that means the same in any reading: a plain key with a quoted text, a day, a number or a text that begins with a letter.
_LINE = re.compile(r'([A-Za-z_][A-Za-z0-9_]{0,99}): (?:"([ !#-\[\]-~]*)"|(\d{4}-\d{2}-\d{2})|(0|[1-9][0-9]{0,17})|([A-Za-z](?:[A-Za-z0-9 _./-]*[A-Za-z0-9_./-])?))')
_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))
_WORDS = {w for x in ("true", "false", "null") for w in (x, x.title(), x.upper())}


def _simple(text: str) -> dict | None:
    """A mapping of simple lines alone, as the parser would read it, at a small part of its cost; null for any other text."""
    out: dict = {}
    for line in text.split("\n"):
        if not line:
            continue
        m = _LINE.fullmatch(line)
        if not m or m[1] in _WORDS or m[5] in _WORDS:
            return None
        if m[3] is not None:
            try:
                out[m[1]] = dt.date.fromisoformat(m[3])
            except ValueError:
                return None
        else:
            out[m[1]] = int(m[4]) if m[4] is not None else m[2] if m[2] is not None else m[5]
    return out or None


def parse(text: str | None) -> str | None:
    """JSON of a YAML mapping; null for malformed text and for anything but a mapping."""
    if text is None:
        return None
    if (simple := _simple(text)) is not None:
        return _JSON.encode({k: v if type(v) in (str, int) else _plain(v) for k, v in simple.items()})
    try:
        value = yaml.load(text, _Loader)  # noqa: S506  a SafeLoader
    except Exception:
        return None
    return _JSON.encode(_plain(value)) if isinstance(value, dict) else None


def dump(text: str | None) -> str | None:
    """Front-matter block of a JSON object; empty for none."""
    value = json.loads(text) if text else {}
    if not value:
        return ""
    return "---\n" + yaml.safe_dump(value, allow_unicode=True, sort_keys=False, default_flow_style=False) + "---\n"


@F.pandas_udf(StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    return s.map(parse)


@F.pandas_udf(StringType())
def json_to_front(s: pd.Series) -> pd.Series:
    return s.map(dump)


@F.pandas_udf(StringType())
def merge_json(old: pd.Series, new: pd.Series) -> pd.Series:
    """Shallow merge of two JSON objects; the second wins, nulls are stored."""
    return pd.Series([json.dumps({**json.loads(a or "{}"), **json.loads(b or "{}")}, ensure_ascii=False, separators=(",", ":")) for a, b in zip(old, new)])


def fm_text(json_col: Column, key: str) -> Column:
    """A field as text: '' for a missing one, lists joined by commas."""
    raw = F.get_json_object(json_col, f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")) & listed.isNotNull(), F.array_join(listed, ",")).otherwise(raw), F.lit(""))


def field_values(raw: Column) -> Column:
    """The texts that a field's raw JSON text is matched by: itself ('' for a missing one), or the items of a list."""
    text = F.coalesce(raw, F.lit(""))
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.when(F.startswith(text, F.lit("[")), items).otherwise(F.array(text))


def field_matches(raw: Column, value: Column) -> Column:
    """Subset test of one field: equal as text, or one item of a list."""
    return F.coalesce(F.array_contains(field_values(raw), value), F.lit(False))


def fm_matches(json_col: Column, key: str, value: Column) -> Column:
    """The same for a field of a JSON object."""
    return field_matches(F.get_json_object(json_col, f"$.{key}"), value)
