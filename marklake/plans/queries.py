"""Registered queries of the engine's own operators, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.yaml import merge_json
from ..operators import comments, edits, index, lexical, links, listing, search, sections, webhooks
from ..scratch import Scratch, kept
from ..streaming.pipeline import windowed_counts
from . import gate

# One note for each order that has lines; the same text runs in both engines.
NOTES_SQL = """
SELECT o.o_orderkey AS note_id,
  concat('20_Projects/', CASE WHEN o.o_orderkey % 3 = 0 THEN 'Pro' ELSE 'Perso' END, '/C', CAST(o.o_custkey AS STRING), '/note-', CAST(o.o_orderkey AS STRING), '.md') AS path,
  concat('title: Order ', CAST(o.o_orderkey AS STRING), chr(10), 'status: ', o.o_orderstatus, chr(10), 'priority: "', o.o_orderpriority, '"', chr(10), 'created: ', substr(CAST(o.o_orderdate AS STRING),1,10), chr(10)) AS fm,
  concat('{"title":"Order ', CAST(o.o_orderkey AS STRING), '","status":"', o.o_orderstatus, '","priority":"', o.o_orderpriority, '"}') AS fm_json,
  substr(CAST(o.o_orderdate AS STRING),1,10) AS created, t.body AS body
FROM orders o JOIN (
  SELECT l_orderkey, concat('# Lines', chr(10), string_agg(line, chr(10)), chr(10), '#order #', CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END) AS body
  FROM (SELECT l_orderkey, max(concat('- [', CASE WHEN l_linestatus = 'F' THEN 'x' ELSE ' ' END, '] ship [[note-', CAST(l_partkey AS STRING), ']] due:: ', substr(CAST(l_shipdate AS STRING),1,10))) AS line FROM lineitem GROUP BY l_orderkey) x
  GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey
"""
WORDS = "thtion attion ertion"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle.replace("{NOTES}", f"({NOTES_SQL})")
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``note_id, path, fm, fm_json, created, body, content`` built from orders and lineitem."""
    df = spark.sql(NOTES_SQL.replace("FROM orders o", "FROM {orders} o").replace("FROM lineitem", "FROM {lineitem}").replace('"}\'', '"}}\'').replace("'{\"title", "'{{\"title"), orders=_table(spark, sf_dir, "orders"), lineitem=_table(spark, sf_dir, "lineitem"))
    return df.withColumn("content", F.concat(F.lit("---\n"), F.col("fm"), F.lit("---\n"), F.col("body")))


def _documents_index(spark, sf_dir) -> lexical.LexicalIndex:
    def build():
        index = lexical.LexicalIndex(spark, Scratch(spark, "documents").path)
        index.apply(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("owner"), F.col("doc_id").cast("string").alias("id"), "text"), 0)
        return index

    return kept(spark, "documents", sf_dir, build)


_TOKENS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = rf"""
w AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
c AS (SELECT doc_id, len(ws) AS len, len(list_filter(ws, lambda x: starts_with(x, 'thtion'))) AS t0, len(list_filter(ws, lambda x: starts_with(x, 'attion'))) AS t1, len(list_filter(ws, lambda x: starts_with(x, 'ertion'))) AS t2 FROM w),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c),
b AS (SELECT doc_id AS id,
   ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / al))
 + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / al))
 + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * len / al)) AS score
 FROM c, s WHERE t0 + t1 + t2 > 0)"""
_VECTOR = "v AS (SELECT vec_id AS id, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0))"


@_query(f"WITH {_BM25} SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM b ORDER BY rank LIMIT 20")
def bm25_topk(spark, sf_dir):
    """From a lexical index that the first search writes and all others read."""
    scores = _documents_index(spark, sf_dir).bm25(WORDS).select(F.col("id").cast("long").alias("id"), F.round("score", 9).alias("score"))
    return search.ranked(scores, "bm25", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@_query(f"WITH {_VECTOR} SELECT id AS vec_id, round(score, 6) AS score FROM v ORDER BY round(score, 9) DESC, id LIMIT 20")
def vector_topk(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings")
    q = df.where("vec_id = 0").select("embedding").first()[0]
    return search.vector_topk(df, q, 20).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@_query(f"""WITH {_BM25}, {_VECTOR},
x AS (SELECT id, 'bm25' AS l, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM b QUALIFY r <= 40
  UNION ALL SELECT id, 'vector', row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM v QUALIFY r <= 40)
SELECT id, round(sum(1.0 / (60 + r)), 9) AS score, max(CASE WHEN l = 'bm25' THEN r END) AS bm25_rank, max(CASE WHEN l = 'vector' THEN r END) AS vector_rank FROM x GROUP BY id""")
def rrf_fuse(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select("embedding").first()[0]
    a = search.ranked(_documents_index(spark, sf_dir).bm25(WORDS).select(F.col("id").cast("long").alias("id"), F.round("score", 9).alias("score")), "bm25", 40)
    b = search.ranked(search.vector_topk(vectors, q, 40).withColumn("score", F.round("score", 9)), "vector", 40)
    return search.fuse(a.unionByName(b)).select("id", F.round("score", 9).alias("score"), "bm25_rank", "vector_rank")


@_query("""SELECT conv_id AS file, max_by(turn, length(text) * 1000 - turn) AS best_turn, max(length(text))::DOUBLE AS score, count(*) AS n_chunks FROM conversations GROUP BY conv_id""")
def collapse_by_note(spark, sf_dir):
    df = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.lit("t").alias("title"), F.col("turn").cast("string").alias("heading"), F.lit(None).cast("string").alias("date"), F.length("text").cast("double").alias("score"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"))
    return search.collapse(df).select("file", F.col("heading").cast("long").alias("best_turn"), "score", F.size("chunks").cast("long").alias("n_chunks"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'thtion') AND trim(x) <> '')"


@_query(f"SELECT doc_id, array_to_string(list_transform({_LINES}[1:3], lambda x: trim(x)), '|') AS matches FROM documents WHERE contains(lower(text), 'thtion') ORDER BY doc_id LIMIT 100")
def grep_search(spark, sf_dir):
    out = search.grep(_table(spark, sf_dir, "documents"), "THtion", limit=100, id_col="doc_id", text_col="text")
    return out.select("doc_id", F.array_join("matches", "|").alias("matches"))


_SIM = "(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END + CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.5 ELSE 0 END)"


@_query(f"SELECT path, round(score, 2) AS score FROM (SELECT p_name AS path, {_SIM.format(a='lower(p_name)', b=chr(39) + 'large part' + chr(39))} AS score FROM (SELECT DISTINCT p_name FROM part)) WHERE score > 0.4 ORDER BY round(score, 2) DESC, path LIMIT 20")
def fuzzy_title(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("path")).distinct()
    return search.fuzzy(names, "Large Part", limit=20, name=F.col("path"), text=F.lit(""))


@_query("SELECT path, created AS date FROM {NOTES} WHERE contains(path, 'Pro') AND json_extract_string(fm_json, '$.status') = 'F'")
def files_filter(spark, sf_dir):
    files = notes(spark, sf_dir).select("path", F.concat(F.substring_index("fm_json", "}", 1), F.lit(',"created":"'), F.col("created"), F.lit('"}')).alias("frontmatter"))
    return listing.list_files(files, path="Pro", status="F").select("path", "date")


@_query("SELECT path, created AS date FROM {NOTES} WHERE created >= '1995-03-01' AND created <= '1995-04-30'")
def files_date_range(spark, sf_dir):
    files = notes(spark, sf_dir).select("path", F.concat(F.lit('{"created":"'), F.col("created"), F.lit('"}')).alias("frontmatter"))
    return listing.list_files(files, since="1995-03-01", before="1995-04-30").select("path", "date")


@_query("SELECT path, CASE WHEN contains(body, '[x]') THEN 1 ELSE 0 END AS completed, regexp_extract(body, 'due:: (\\d{4}-\\d{2}-\\d{2})', 1) AS due, regexp_extract(body, '- \\[.\\] ([^\\n]*)', 1) AS text FROM {NOTES}")
def tasks_due(spark, sf_dir):
    return index.tasks(notes(spark, sf_dir)).select(F.col("file_path").alias("path"), "completed", "due", "text")


@_query("SELECT tag, count(*) AS n FROM (SELECT unnest(['order', CASE WHEN note_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag FROM {NOTES}) GROUP BY tag")
def tags_distinct(spark, sf_dir):
    tags = notes(spark, sf_dir).select(F.explode(T.all_tags(F.lit(None).cast("array<string>"), F.col("body"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@_query("SELECT path, concat('Order ', CAST(note_id AS STRING)) AS title, created, '[\"order\",\"' || CASE WHEN note_id % 2 = 0 THEN 'even' ELSE 'odd' END || '\"]' AS tags, substr(fm_json, 1, length(fm_json) - 1) || ',\"created\":\"' || created || 'T00:00:00.000Z\"}' AS frontmatter FROM {NOTES}")
def files_index(spark, sf_dir):
    raw = notes(spark, sf_dir).select("path", "content", F.lit("2026-01-01").cast("timestamp").alias("mtime"))
    return index.files(index.parsed(raw)).select("path", "title", "created", F.to_json("tags").alias("tags"), "frontmatter")


@_query("SELECT path, json_extract_string(fm_json, '$.title') AS title FROM {NOTES} WHERE json_extract_string(fm_json, '$.status') = 'O' AND path ILIKE '%/pro/%'")
def json_filter(spark, sf_dir):
    files = notes(spark, sf_dir).select("path", F.col("fm_json").alias("frontmatter"))
    return gate.query(spark, {"files": files}, "SELECT path, json_extract(frontmatter, '$.title') AS title FROM files WHERE json_extract(frontmatter, '$.status') = 'O' AND path LIKE '%/pro/%'")


@_query("SELECT path FROM {NOTES} WHERE starts_with(path, '20_Projects/Pro/') AND NOT starts_with(path, '20_Projects/Pro/C1/') AND NOT starts_with(path, '20_Projects/Pro/C10/')")
def path_prefix_acl(spark, sf_dir):
    df = notes(spark, sf_dir).select("path")
    return df.where(P.can_access_file(F.col("path"), ["20_Projects/Pro"], ["20_Projects/Pro/C1", "20_Projects//Pro/./C10/"]))


_RESOLVED = "SELECT n.path AS src, regexp_extract(n.body, '\\[\\[([^\\]\\n]+)\\]\\]', 1) AS target, m.path AS resolved FROM {NOTES} n LEFT JOIN {NOTES} m ON regexp_extract(n.body, '\\[\\[([^\\]\\n]+)\\]\\]', 1) = concat('note-', CAST(m.note_id AS STRING))"


@_query(f"SELECT src, target, resolved IS NOT NULL AS \"exists\", resolved FROM ({_RESOLVED})")
def links_resolve(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.col("body").alias("content"))
    return links.resolve(links.edges(df), df).select("src", "target", "exists", "resolved")


@_query(f"SELECT src, count(*) AS count, count(*) FILTER (resolved IS NULL) AS broken_count FROM ({_RESOLVED}) GROUP BY src")
def links_summary(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.col("body").alias("content"))
    return links.summary(links.resolve(links.edges(df), df))


@_query(f"SELECT target, name, round(score, 6) AS score, rank FROM (SELECT target, name, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, name) AS rank FROM (SELECT target, name, {_SIM.format(a='target', b='name')} AS score FROM (SELECT DISTINCT replace(lower(p_name), 'a', '') AS target FROM part), (SELECT DISTINCT lower(p_name) AS name FROM part)) WHERE score > 0.3) WHERE rank <= 3")
def links_broken_suggest(spark, sf_dir):
    out = links.suggest(_table(spark, sf_dir, "part").select(F.replace(F.lower("p_name"), F.lit("a"), F.lit("")).alias("target")), _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return out.select("target", "name", F.round("score", 6).alias("score"), "rank")


@_query("SELECT DISTINCT concat('C', CAST(o_custkey AS STRING)) AS name, 'directory' AS type FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def dir_listing(spark, sf_dir):
    return listing.directory(notes(spark, sf_dir).select("path"), "/20_Projects/Pro/")


@_query("SELECT DISTINCT concat('C', CAST(o_custkey AS STRING)) AS name FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def projects(spark, sf_dir):
    return listing.projects(notes(spark, sf_dir).select("path"))


@_query("SELECT 0 AS pos, 'missing.md' AS path, CAST(NULL AS STRING) AS content, 'File not found' AS error UNION ALL SELECT 1, '../x.md', NULL, 'Access denied' UNION ALL SELECT 2, (SELECT min(path) FROM {NOTES}), (SELECT arg_min(body, path) FROM {NOTES}), NULL")
def batch_read(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.col("body").alias("content"))
    first = df.agg(F.min("path")).first()[0]
    return listing.batch_read(spark, df, ["missing.md", "../x.md", first]).select("pos", "path", "content", "error")


@_query("SELECT path, CASE WHEN note_id % 5 = 0 THEN 'remove' ELSE 'add' END AS action FROM {NOTES} WHERE (note_id % 5 = 0) <> (note_id % 7 = 0)")
def reconcile_diff(spark, sf_dir):
    df = notes(spark, sf_dir)
    return index.reconcile(df.where("note_id % 7 <> 0"), df.where("note_id % 5 <> 0"))


_KIND = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END"


@_query(f"""SELECT path, title, completed FROM (SELECT concat('u', CAST(user_id AS STRING), '.md') AS path, max_by(event_id, event_id) AS last, max_by({_KIND}, event_id) AS kind, concat('Event ', CAST(max(event_id) AS STRING)) AS title, CASE WHEN max(event_id) % 2 = 0 THEN 1 ELSE 0 END AS completed FROM events GROUP BY user_id) WHERE kind <> 'unlink'
UNION ALL SELECT 'kept.md', 'kept', NULL""")
def index_merge(spark, sf_dir):
    ev = _table(spark, sf_dir, "events")
    content = F.concat(F.lit("---\ntitle: Event "), F.col("event_id"), F.lit("\n---\n- ["), F.when(F.col("event_id") % 2 == 0, "x").otherwise(" "), F.lit("] do it"))
    changes = ev.select(F.expr(_KIND).alias("event"), F.concat(F.lit("u"), F.col("user_id"), F.lit(".md")).alias("path"), content.alias("content"), "ts", F.col("event_id").alias("seq"))
    old = spark.createDataFrame([("kept.md", ""), ("u1.md", "- [ ] old")], "path string, content string").withColumn("mtime", F.lit("2023-01-01").cast("timestamp"))
    base = index.parsed(old)
    files, tasks = index.apply_events(index.files(base), index.tasks(base), changes)
    return files.join(tasks, files.path == tasks.file_path, "left").select("path", "title", "completed")


@_query("SELECT path, replace(body, 'ship', 'send') AS content, (length(body) - length(replace(body, 'ship', ''))) // 4 AS occurrences FROM {NOTES}")
def patch_all(spark, sf_dir):
    df = notes(spark, sf_dir)
    return df.select("path", edits.patched(F.col("body"), "ship", "send", True).alias("content"), T.occurrences(F.col("body"), F.lit("ship")).cast("long").alias("occurrences"))


@_query("SELECT path, '{\"title\":\"Order ' || CAST(note_id AS STRING) || '\",\"status\":\"done\",\"priority\":' || to_json(json_extract_string(fm_json, '$.priority'))::VARCHAR || ',\"seen\":null}' AS frontmatter FROM {NOTES}")
def frontmatter_merge(spark, sf_dir):
    df = notes(spark, sf_dir)
    return df.select("path", F.replace(F.replace(merge_json(F.col("fm_json"), F.lit('{"status":"done","seen":null}')), F.lit(": "), F.lit(":")), F.lit(", "), F.lit(",")).alias("frontmatter"))


@_query("SELECT CASE WHEN note_id % 4 = 0 THEN concat('.trash/', path) ELSE path END AS path FROM {NOTES} WHERE NOT (note_id % 4 = 0 AND created < '1995-01-01')")
def trash_purge(spark, sf_dir):
    df = notes(spark, sf_dir).select(F.when(F.col("note_id") % 4 == 0, F.concat(F.lit(".trash/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.col("created").cast("timestamp").alias("mtime"))
    return edits.purge(df, "1995-01-31 00:00:00", 30).select("path")


@_query("SELECT CASE WHEN note_id % 6 = 0 THEN concat('.trash/', path) WHEN starts_with(path, '20_Projects/Perso/') THEN concat('Archive/', substr(path, 19)) ELSE path END AS path FROM {NOTES}")
def move_and_delete(spark, sf_dir):
    df = notes(spark, sf_dir)
    gone = df.where("note_id % 6 = 0").select("path")
    moved = edits.delete(df.select("path", "content"), gone, "2026-01-01 00:00:00")
    return edits.move_folder(moved, "20_Projects/Perso", "Archive").select("path")


@_query("SELECT event, path, hook FROM (SELECT CASE WHEN note_id % 2 = 0 THEN 'add' ELSE 'unlink' END AS event, path, unnest([CASE WHEN starts_with(path, '20_Projects/Pro/') AND json_extract_string(fm_json, '$.status') = 'F' THEN 'a' END, CASE WHEN note_id % 2 = 1 AND json_extract_string(fm_json, '$.status') <> 'O' THEN 'b' END]) AS hook FROM {NOTES}) WHERE hook IS NOT NULL")
def webhook_match(spark, sf_dir):
    ev = notes(spark, sf_dir).select(F.when(F.col("note_id") % 2 == 0, "add").otherwise("unlink").alias("event"), "path", F.col("fm_json").alias("frontmatter"), F.lit("2026-01-01").cast("timestamp").alias("ts"))
    rules = webhooks.create(webhooks.empty(spark), "https://hooks.example.com/a", "2026-01-01", folder="20_Projects/Pro", frontmatter={"status": "F"}, key="a")
    rules = webhooks.create(rules, "https://hooks.example.com/b", "2026-01-01", frontmatter_not={"status": "O"}, events=["unlink"], key="b")
    return webhooks.match(ev, rules).select("event", "path", F.col("webhook_id").alias("hook"))


@_query("SELECT path, contains(body, '[x]') AS completed, concat('ship [] due:: ', regexp_extract(body, 'due:: (\\d{4}-\\d{2}-\\d{2})', 1)) AS text, concat('[note-', regexp_extract(body, 'note-(\\d+)', 1)) AS tags FROM {NOTES}".replace("ship [] due", "ship ] due"))
def task_extract_isolate(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.inline(T.loose_tasks(F.col("content"), True)))
    return df.select("path", "completed", "text", F.array_join("tags", ",").alias("tags"))


_SQL = {
    "sql_join_group": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus != 'P' GROUP BY n_name HAVING count(*) > 3",
    "sql_window": "SELECT o_orderkey, r FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 2",
    "sql_setops": "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT s_suppkey FROM supplier",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1-%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_subquery": "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY p_brand",
    "sql_group_concat": "SELECT n_regionkey, length(group_concat(n_name, ',')) AS n FROM nation GROUP BY n_regionkey",
}


def _pass_through(name: str, sql: str):
    def run(spark, sf_dir):
        names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
        return gate.query(spark, {n: _table(spark, sf_dir, n) for n in names}, sql)

    run.__name__ = name
    _query(sql.replace(" LIKE ", " ILIKE ").replace("group_concat", "string_agg"))(run)


for _name, _text in _SQL.items():
    _pass_through(_name, _text)


@_query("SELECT conv_id, turn, concat('c', CAST(conv_id AS STRING), 't', CAST(turn AS STRING)) AS id, 'open' AS status, CASE WHEN turn % 2 = 0 THEN 'span' END AS anchored_text, role AS author, regexp_replace(text, '[ \\t]*$', '') AS text FROM conversations")
def comments_extract(spark, sf_dir):
    key = F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn"))
    body = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    anchor = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<!--c:"), key, F.lit("--> span <!--/c:"), key, F.lit("-->"))).otherwise("span")
    content = F.concat(F.lit("Intro "), anchor, F.lit("\n<!--co:"), key, F.lit(' by:me at:2026-01-01 status:open quote:"span"\n'), F.col("role"), F.lit(" (2026-01-02): "), body, F.lit("\n-->\n"))
    df = _table(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"))
    rows = df.select("conv_id", "turn", F.inline(comments.parse("content")))
    return rows.select("conv_id", "turn", "id", "status", "anchored_text", F.col("replies")[0]["author"].alias("author"), F.regexp_replace(F.col("replies")[0]["text"], r"[ \t]*\z", "").alias("text"))


@_query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    return windowed_counts(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@_query("SELECT count(*) AS chunks, count(*) FILTER (vec_id % 3 <> 0) AS embedded, count(*) FILTER (vec_id % 3 = 0) AS pending, false AS semantic_ready FROM embeddings")
def search_status(spark, sf_dir):
    return search.status(_table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding")))


def _documents(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.col("text").alias("body"))


@_query()
def chunk_documents(spark, sf_dir):
    return sections.chunks(_documents(spark, sf_dir))


from . import index_queries, more_queries  # noqa: E402,F401  they register their queries with the functions above
