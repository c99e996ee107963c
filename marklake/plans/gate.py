"""SQL over the index: a gate that lets only queries through, and a shim for the dialect notes are written in."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.DOTALL)  # texts and comments stay as they are


class Refused(ValueError):
    """The text is not a query that may run here."""


def _outside_strings(sql: str, change) -> str:
    out, at = [], 0
    for m in _STRING.finditer(sql):
        out += [change(sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(sql[at:])])


_COMPARED = re.compile(r"\s*(?:=|==|!=|<>|<=|>=|<|>|between\s)\s*[-+]?\.?\d", re.I)
_BEFORE = re.compile(r"\d\s*(?:=|==|!=|<>|<=|>=|<|>)\s*\Z")
_ORDERED = re.compile(r"\border\s+by\s(?:[^()]|\([^()]*\))*\Z", re.I)


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens just before ``at``, and the place after its end."""
    out, depth, start = [], 0, at
    ends = {m.start(): m.end() for m in _STRING.finditer(sql)}
    while at < len(sql):
        if at in ends:
            at = ends[at]
            continue
        c = sql[at]
        if c == ")" and depth == 0:
            return [*out, sql[start:at].strip()], at + 1
        if c == "," and depth == 0:
            out.append(sql[start:at].strip())
            start = at + 1
        depth += (c == "(") - (c == ")")
        at += 1
    return [], at


def typed_order(doc: str, path: str) -> tuple[str, str, str]:
    """SQL of the three keys that JSON values are ordered by: nothing, numbers, texts; the number (booleans are 1 and 0), the text."""
    plain = f"get_json_object({doc}, {path})"
    kind = f"schema_of_variant(try_variant_get(try_parse_json({doc}), {path}, 'variant'))"
    number = f"(CASE WHEN {kind} = 'BOOLEAN' THEN if({plain} = 'true', 1.0D, 0.0D) WHEN {kind} RLIKE '^(BIGINT|DOUBLE|DECIMAL|FLOAT)' THEN try_cast({plain} AS double) END)"
    return f"CASE WHEN {plain} IS NULL THEN 0 WHEN {number} IS NULL THEN 2 ELSE 1 END", number, plain


def _typed(sql: str) -> str:
    """``json_extract`` with the types of JSON: numbers (booleans are 1 and 0) where a number is compared with it, numbers before texts where rows are ordered by it, else text."""
    text, at = "", 0
    strings = [(m.start(), m.end()) for m in _STRING.finditer(sql)]
    for m in re.finditer(r"\bjson_extract\s*\(", sql, flags=re.I):
        if m.start() < at or any(a <= m.start() < b for a, b in strings):
            continue
        found, end = _arguments(sql, m.end())
        if len(found) != 2:
            continue
        doc, path = _typed(found[0]), found[1]
        order, number, plain = typed_order(doc, path)
        text += sql[at : m.start()]
        if _ORDERED.search(text):
            way = re.match(r"\s*(asc|desc)\b", sql[end:], re.I)
            down = f" {way[1]}" if way else ""
            text += f"{order}{down}, {number}{down}, {plain}"
        else:
            text += number if _COMPARED.match(sql, end) or _BEFORE.search(text) else plain
        at = end
    return text + sql[at:]


def translate(sql: str) -> str:
    """The dialect of the documented queries in Spark SQL: LIKE without case, ``date('now', ...)``, ``json_extract``, ``group_concat``."""

    def shifted(m: re.Match) -> str:
        out = "current_date()"
        for n, unit in re.findall(r"'\s*([+-]?\d+)\s+(day|month|year)s?\s*'", m[1] or ""):
            out = f"date_add({out}, {int(n)})" if unit == "day" else f"add_months({out}, {int(n) * (12 if unit == 'year' else 1)})"
        return f"cast({out} as string)"

    sql = re.sub(r"\bdate\s*\(\s*'now'((?:\s*,\s*'[^']*')*)\s*\)", shifted, sql, flags=re.I)
    sql = _outside_strings(sql, lambda s: re.sub(r"\blike\b", "ILIKE", s, flags=re.I))
    sql = _typed(sql)
    return _outside_strings(sql, lambda s: re.sub(r"\bgroup_concat\s*\(", "string_agg(", s, flags=re.I))


# What a query may be made of.  Anything that the parser gives another name is refused.
PLANS = """Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases
Union Except Intersect Distinct WithWindowDefinition UnresolvedWith UnresolvedInlineTable OneRowRelation LocalRelation UnresolvedRelation UnresolvedTableValuedFunction
UnresolvedTVFAliases Generate Window Pivot Unpivot""".split()
FUNCTIONS = """abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_sort asin atan atan2 avg
bool_and bool_or btrim cast ceil ceiling char char_length character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos count count_if
cume_dist curdate current_date current_timestamp date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayname dayofmonth
dayofweek dayofyear dense_rank element_at endswith every exp explode explode_outer extract filter first first_value flatten floor from_unixtime get get_json_object
greatest group_concat hour if ifnull in initcap instr isnan isnotnull isnull json_array_length json_object_keys lag last last_day last_value lcase lead least left length
levenshtein like listagg ln locate log log10 log2 lower lpad ltrim make_date max max_by md5 mean median min min_by minute mod mode month months_between named_struct
next_day not now nth_value ntile nullif nullifzero nvl nvl2 overlay parse_json percent_rank percentile percentile_approx pi posexplode position pow power quarter radians rank regexp
regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr repeat replace reverse right rlike round row_number rpad rtrim schema_of_variant second
sequence sha2 sign sin size some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum tan
to_char to_date to_json to_timestamp transform translate trim trunc try_add try_cast try_divide try_element_at try_parse_json try_subtract try_to_number try_to_timestamp
try_variant_get typeof ucase unix_timestamp upper var_pop var_samp variance variant_get weekday weekofyear when year zeroifnull add_months current_timezone""".split()


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _walk(node, plans: list, functions: list, relations: list, names: set) -> None:
    """Collect what a parsed plan is made of, subqueries and named queries included."""
    kind = node.getClass().getSimpleName()
    plans.append(kind)
    if kind == "UnresolvedRelation":
        relations.append([str(p) for p in _each(node.multipartIdentifier())])
    if kind == "UnresolvedTableValuedFunction":
        functions.append(".".join(str(p) for p in _each(node.name())).lower())
    if kind == "UnresolvedWith":
        names.update(str(r._1()).lower() for r in _each(node.cteRelations()))
        for r in _each(node.cteRelations()):
            _walk(r._2(), plans, functions, relations, names)
    for child in _each(node.children()):
        _walk(child, plans, functions, relations, names)
    for e in _each(node.expressions()):
        _walk_expression(e, plans, functions, relations, names)


def _walk_expression(e, plans: list, functions: list, relations: list, names: set) -> None:
    kind = e.getClass().getSimpleName()
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = [str(p) for p in _each(e.nameParts())] if kind == "UnresolvedFunction" else [e.name().unquotedString()]
        functions.append(".".join(parts).lower())
    elif "Invoke" in kind or "Reflect" in kind or "IdentifierClause" in kind or kind == "ExpressionWithUnresolvedIdentifier":
        functions.append(kind)
    if is_instance_of(SparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        _walk(e.plan(), plans, functions, relations, names)
    for child in _each(e.children()):
        _walk_expression(child, plans, functions, relations, names)


def check(spark: SparkSession, sql: str, allow_with: bool = False, views: tuple[str, ...] | None = None, functions: tuple[str, ...] = ()) -> None:
    """Refuse everything but one SELECT (or, if allowed, WITH) over the given ``views`` and listed functions.

    The parsed plan is walked, subqueries and named queries included: its operators must be
    those of a query, its relations given views or queries named in it (never files or other
    catalogs), its functions among :data:`FUNCTIONS` and ``functions``.
    """
    first = re.match(r"\s*(select|with)\b", sql, re.I)
    if not first or (first[1].upper() == "WITH" and not allow_with):
        raise Refused("only SELECT is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(str(e).split("\n")[0]) from None
    plans, called, relations, names = [], [], [], set()
    _walk(plan, plans, called, relations, names)
    for kind in plans:
        if kind not in PLANS:
            raise Refused(f"not a query: {kind}")
    for name in called:
        if name not in FUNCTIONS and name not in functions:
            raise Refused(f"function not allowed: {name}")
    if views is not None:
        known = {v.lower() for v in views} | names
        for parts in relations:
            if len(parts) != 1 or parts[0].lower() not in known:
                raise Refused(f"unknown table: {'.'.join(parts)}")


def query(spark: SparkSession, views: dict[str, DataFrame], sql: str, *, allow_with: bool = False, restricted: bool = False) -> DataFrame:
    """Run a query over the given views; callers that may read parts only are refused, since SQL sees whole tables.

    The views live in a session of their own, with lenient arithmetic as the dialect has it.
    """
    if restricted:
        raise Refused("not available to callers with path limits")
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "false")
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    text = translate(sql)
    check(own, text, allow_with, tuple(views))
    for name, df in views.items():
        # the same plan, bound to the other session
        plan = df._jdf.queryExecution().analyzed()
        own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan).createOrReplaceTempView(name)
    return own.sql(text)


def index_views(files: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """The tables as their users know them: ``tags`` as JSON text, tasks with a number."""
    return {"files": files.withColumn("tags", F.to_json("tags")), "tasks": tasks}


def sections(content: str) -> list[dict]:
    """``{heading, sql, dataview}`` of an index note: the first fenced block of each kind below each heading."""
    out: list[dict] = []
    fence, block = None, []
    current = {"heading": "", "sql": None, "dataview": None}
    for line in [*content.split("\n"), "# "]:
        s = line.strip()
        if fence is not None:
            if s.startswith("```"):
                if fence in current and current[fence] is None:
                    current[fence] = "\n".join(block).strip()
                fence, block = None, []
            elif not (fence == "sql" and s.startswith("--")):
                block.append(line)
        elif s.startswith("```"):
            fence, block = s[3:].strip().lower(), []
        elif re.match(r"#{1,6}\s", line) or line == "# ":
            if current["sql"] or current["dataview"]:
                out.append(current)
            current = {"heading": line.lstrip("#").strip(), "sql": None, "dataview": None}
    return out


def run_index(spark: SparkSession, views: dict[str, DataFrame], content: str, heading: str) -> DataFrame:
    """The query of one section of an index note, found by its heading without case."""
    for s in sections(content):
        if s["heading"].lower() == heading.strip().lower() and s["sql"]:
            return query(spark, views, s["sql"])
    raise KeyError(heading)


def table_text(df: DataFrame, limit: int = 100) -> str:
    """A text table of at most ``limit`` rows."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    width = [max(map(len, c)) for c in zip(df.columns, *rows)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, width))
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in width), *map(line, rows)])
