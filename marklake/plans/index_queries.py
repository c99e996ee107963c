"""Registered queries over structures that are written once and kept: the lexical index, chunks with vectors, the stream's store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, listing, search, webhooks
from ..operators.lexical import LexicalIndex
from ..scratch import Scratch
from ..streaming import pipeline
from . import gate
from .queries import _TOKENS, WORDS, _query, _table, notes
from .sample import letter_vectors

# ---- the lexical index after three batches: all documents, then changes and removals, then some of them again ----
_AFTER = """SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN text WHEN doc_id % 5 = 0 THEN concat(text, ' thtion thtion') WHEN doc_id % 14 = 0 THEN 'Attion again ertion' ELSE text END AS text
FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 <> 0 AND doc_id % 14 <> 0)"""


def after_batches(spark, sf_dir) -> LexicalIndex:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("owner"), F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    index = LexicalIndex(spark, Scratch(spark, "lexical").path)
    index.apply(docs, 0)
    index.apply(docs.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" thtion thtion"))), 1, docs.where("doc_id % 7 = 0 AND doc_id % 5 <> 0"))
    again = docs.where("doc_id % 14 = 0 AND doc_id % 5 <> 0").withColumn("text", F.lit("Attion again ertion"))
    index.apply(docs.where("doc_id % 15 = 0").unionByName(again), 2)
    return index


@_query(f"SELECT CAST(doc_id AS STRING) AS id, term, count(*)::DOUBLE AS tf, length FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM (SELECT doc_id, {_TOKENS} AS ws FROM ({_AFTER}))) GROUP BY ALL")
def lexical_segments(spark, sf_dir):
    """Every living posting: as a fresh build of what the batches left would have it."""
    return after_batches(spark, sf_dir).postings().select("id", "term", "tf", "length")


def _bm25_sql(docs: str) -> str:
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in range(3))
    counts = ", ".join(f"len(list_filter(ws, lambda x: starts_with(x, '{w}'))) AS t{i}" for i, w in enumerate(WORDS.split()))
    return f"""WITH w AS (SELECT doc_id, {_TOKENS} AS ws FROM ({docs})), c AS (SELECT doc_id, len(ws) AS len, {counts} FROM w),
s AS (SELECT count(*) AS n, avg(len) AS al, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(3))} FROM c)
SELECT CAST(doc_id AS STRING) AS id, round({score}, 6) AS score FROM c, s WHERE t0 + t1 + t2 > 0"""


@_query(_bm25_sql(_AFTER))
def lexical_scores(spark, sf_dir):
    """BM25 of all documents that hold a term, from segments and tombstones."""
    return after_batches(spark, sf_dir).bm25(WORDS).select("id", F.round("score", 6).alias("score"))


# ---- vectors by content: moved over two batches, copied, and never embedded twice ----
_CONTENT = "concat('---', chr(10), 'title: ', c_name, chr(10), '---', chr(10), 'Segment ', c_mktsegment, ' of ', c_name)"


@_query("SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('moved/', CAST(c_custkey AS STRING), '.md') ELSE concat('c/', CAST(c_custkey AS STRING), '.md') END AS path, length(concat('Segment ', c_mktsegment, ' of ', c_name))::DOUBLE AS first FROM customer UNION ALL SELECT concat('copy/', CAST(c_custkey AS STRING), '.md'), length(concat('Segment ', c_mktsegment, ' of ', c_name)) FROM customer WHERE c_custkey % 3 = 1")
def vectors_moved(spark, sf_dir):
    store = pipeline.Store(spark, Scratch(spark, "vectors").path, buckets=8)
    path = lambda folder: F.concat(F.lit(folder), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path")
    customers = _table(spark, sf_dir, "customer")
    change = lambda df, event, folder: df.select(F.lit(event).alias("event"), path(folder), F.expr(_CONTENT).alias("content"), F.lit("2026-01-01").cast("timestamp").alias("ts"))
    pipeline.batch(store, change(customers, "add", "c/"), 0, model="letters")
    pipeline.embed(store, letter_vectors, "letters", 1)
    third = customers.where("c_custkey % 3 = 0")
    pipeline.batch(store, change(third, "unlink", "c/"), 2, model="letters")
    pipeline.batch(store, change(third, "add", "moved/").unionByName(change(customers.where("c_custkey % 3 = 1"), "add", "copy/")), 3, model="letters")
    return store.table("chunks").select(F.col("file_path").alias("path"), F.col("embedding")[0].cast("double").alias("first"))


# ---- a rule for every order, met by the events of a folder with one value in their front matter ----
@_query("""SELECT event_id, count(*) AS n, max(o_orderkey) AS last FROM events JOIN orders ON user_id % 50 = o_custkey % 50 AND json_extract_string(props, '$.k') = CAST(o_orderkey % 100 AS STRING)
WHERE o_orderstatus <> 'P' AND (o_orderkey % 3 > 0 OR event_type = 'view') AND (o_orderkey % 5 > 0 OR event_type <> 'click') GROUP BY event_id""")
def rules_table(spark, sf_dir):
    key = F.col("o_orderkey")
    pairs = lambda k, v: F.create_map(F.lit(k), v)
    rules = _table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"), (F.col("o_orderstatus") != "P").alias("enabled"), F.lit("https://hooks.example.com/").alias("url"), F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string"), F.when(key % 2 == 0, "/*/").otherwise("")).alias("folder"),
        pairs("k", (key % 100).cast("string")).alias("frontmatter"), F.when(key % 5 == 0, pairs("type", F.lit("click"))).alias("frontmatter_not"), F.when(key % 3 == 0, F.array(F.lit("unlink"))).alias("events"), F.lit(None).cast("string").alias("secret"), F.lit(False).alias("include_body"),
    )
    front = F.concat(F.regexp_replace("props", r"\}\s*\z", ""), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    path = F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"), F.lit("/x/y/"), F.col("event_id").cast("string"), F.lit(".md"))
    events = _table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "unlink").otherwise("add").alias("event"), path.alias("path"), front.alias("frontmatter"), "ts")
    met, members = webhooks.match_classes(events, rules)
    held = members.groupBy("class").agg(F.count("*").alias("n"), F.max(F.col("id").cast("long")).alias("last"))
    event = F.regexp_extract("path", r"(\d+)\.md", 1).cast("long")
    return met.join(held, "class").groupBy(event.alias("event_id")).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


# ---- what every caller may see, in one plan ----
@_query("""SELECT id, count(*) AS n, min(path) AS first FROM (SELECT c_custkey AS id, path FROM customer JOIN {NOTES} n ON n.path LIKE concat('%/C', CAST(c_custkey AS STRING), '/%') AND (c_custkey % 3 > 0 OR n.path LIKE '20_Projects/Pro/%') WHERE c_custkey % 500 > 0
UNION ALL SELECT c_custkey, path FROM customer, {NOTES} n WHERE c_custkey % 500 = 0 AND n.path NOT LIKE '20_Projects/Pro/%') GROUP BY id""")
def visible_notes(spark, sf_dir):
    """Most callers may see one customer's folders (some not those of one root); a few have no allow list, and one root denied."""
    key = F.col("c_custkey")
    folder = lambda root: F.concat(F.lit(root), key.cast("string"), F.lit("/"))
    broad = key % 500 == 0
    callers = _table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(~broad, F.array(folder("20_Projects/Pro/C"), folder("20_Projects//Perso/./C"), F.lit("../C"))).alias("path_allow"),
        F.when(broad, F.array(F.lit("20_Projects/Pro"))).when(key % 3 == 0, F.array(folder("20_Projects/Perso/C"), F.lit("else"))).alias("path_deny"),
    )
    seen, members = access.visible_classes(notes(spark, sf_dir), callers)
    return seen.groupBy("class").agg(F.count("*").alias("n"), F.min("path").alias("first")).join(members, "class").select("id", "n", "first")


# ---- the nearest ten of every vector ----
@_query("""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v) WHERE rank <= 10""")
def vector_topk_all(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return search.vector_topk_batch(vectors, vectors, 10, block=1000).withColumn("score", F.round("score", 6))


# ---- the outbox: a repeated batch sends nothing again ----
@_query("SELECT CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event, count(*) AS sent, sum(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END)::BIGINT AS tries FROM events GROUP BY 1")
def stream_outbox(spark, sf_dir):
    store = pipeline.Store(spark, Scratch(spark, "outbox").path, buckets=4)
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END")
    changes = _table(spark, sf_dir, "events").select(kind.alias("event"), F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"), F.lit("text").alias("content"), "ts", F.col("event_id").alias("seq"))
    rules = webhooks.create(webhooks.empty(spark), "https://hooks.example.com/all", "2026-01-01", key="all")
    tried: dict[str, int] = {}

    def transport(url, body, headers, timeout):
        import json

        path = json.loads(body)["path"]
        tried[path] = tried.get(path, 0) + 1  # in the task's process
        return 503 if int(path[2:-3]) % 4 == 0 and tried[path] == 1 else 200

    for _ in range(2):
        pipeline.batch(store, changes, 0, rules, transport, guard=None, sleep=lambda s: None)
    return store.sent(0).groupBy("event").agg(F.count("*").alias("sent"), F.sum("tries").cast("long").alias("tries"))


# ---- listings in the reader's order ----
_NAME = "concat(CASE p_partkey % 4 WHEN 0 THEN 'Élan ' WHEN 1 THEN 'elbow ' WHEN 2 THEN 'Zebra ' ELSE 'apple ' END, lpad(CAST(p_partkey AS STRING), 9, '0'))"


@_query(f"SELECT name, 'directory' AS type FROM (SELECT {_NAME} AS name FROM part) ORDER BY lower(strip_accents(name)) LIMIT 1200")
def listing_order(spark, sf_dir):
    """Accents and case don't part names: the first folders, as a reader would look them up."""
    paths = _table(spark, sf_dir, "part").select(F.concat(F.lit("d/"), F.expr(_NAME), F.lit("/x.md")).alias("path"))
    return listing.directory(paths, "d").limit(1200)


# ---- numbers, booleans and texts out of JSON ----
_VALUE = "CASE event_id % 4 WHEN 0 THEN concat('{\"v\": ', CAST(event_id % 120 AS STRING), '}') WHEN 1 THEN '{\"v\": true}' WHEN 2 THEN concat('{\"v\": \"', CAST(event_id AS STRING), '\"}') ELSE concat('{\"v\": ', CAST(event_id % 7 AS STRING), '.5}') END"


@_query("""WITH e AS (SELECT event_id, event_id % 4 = 2 AS is_text, CASE event_id % 4 WHEN 0 THEN (event_id % 120)::DOUBLE WHEN 1 THEN 1.0 WHEN 3 THEN event_id % 7 + 0.5 END AS num, CAST(event_id AS STRING) AS txt FROM events)
SELECT event_id, r, num >= 5.5 AS high FROM (SELECT *, row_number() OVER (ORDER BY is_text DESC, CASE WHEN is_text THEN txt END DESC, num DESC, event_id) AS r FROM e) WHERE num >= 1 OR is_text""")
def json_typed(spark, sf_dir):
    """Values compared and ordered as numbers (true is 1) or texts, whichever they are."""
    events = _table(spark, sf_dir, "events").select("event_id", F.expr(_VALUE).alias("front"))
    rows = gate.query(spark, {"e": events}, "SELECT event_id, front, json_extract(front, '$.v') >= 5.5 AS high, CASE WHEN json_extract(front, '$.v') >= 1 THEN 1 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS shown FROM e")
    keys = {f"_key{i}": F.expr(k) for i, k in enumerate(gate.typed_order("front", "'$.v'"))}  # columns, or the sort would parse at each comparison
    ordered = rows.withColumns(keys).drop("front").orderBy(*[F.desc(k) for k in keys], "event_id").drop(*keys)
    return listing.numbered(ordered, "r").where("shown = 1").select("event_id", "r", "high")
