"""Further registered queries: search over chunked notes, edits, comments, tokens, rules, access and dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import udtf
from ..functions.yaml import json_to_front
from ..operators import access, comments, edits, index, links, listing, search, sections, tokens, webhooks
from ..operators.lexical import LexicalIndex
from ..schema import TOKENS
from ..scratch import Scratch, kept
from ..streaming import deliver, pipeline
from . import gate
from .queries import NOTES_SQL, WORDS, _query, _table, notes
from .sample import letter_vectors

# ---- notes with headings: short neighbours, a fence, a long section, one paragraph that must be cut ----
_NOTE = "FROM orders"
_TITLE = "concat('Order ', CAST(o_orderkey AS STRING))"
_LONG = "concat('All lines of customer ', CAST(o_custkey AS STRING), ' thtion. ', repeat('shipped ertion; ', 20))"
_FENCED = "concat('```', chr(10), '# no heading', chr(10), '```', chr(10), repeat('attion text ', 25))"
_RUN = "concat(CAST(o_orderkey AS STRING), repeat('x', 2400))"
_BODY = f"""concat('# ', {_TITLE}, chr(10), chr(10), 'Intro.', chr(10), chr(10), '## Budget', chr(10), chr(10), 'Small part.', chr(10), chr(10),
'## Lines', chr(10), chr(10), {_LONG}, chr(10), '### Detail', chr(10), {_FENCED}, chr(10), chr(10), '## Run', chr(10), {_RUN})"""
HEADED_SQL = f"SELECT o_orderkey AS note_id, concat('n/', CAST(o_orderkey AS STRING), '.md') AS path, {_TITLE} AS title, substr(CAST(o_orderdate AS STRING), 1, 10) AS date, {_BODY} AS body {_NOTE}"
_PIECES = f"""
SELECT o_orderkey AS note_id, 0 AS i, {_TITLE} AS heading, concat('Intro.', chr(10), chr(10), 'Small part.', chr(10), chr(10), {_LONG}) AS text, 3 AS start_line, 11 AS end_line {_NOTE}
UNION ALL SELECT o_orderkey, 1, concat({_TITLE}, ' > Lines > Detail'), {_FENCED}, 13, 16 {_NOTE}
UNION ALL SELECT o_orderkey, 2, concat({_TITLE}, ' > Run'), substr({_RUN}, 1, 2200), 19, 19 {_NOTE}
UNION ALL SELECT o_orderkey, 3, concat({_TITLE}, ' > Run'), substr({_RUN}, 1901), 19, 19 {_NOTE}
"""
CHUNKS_SQL = f"""SELECT concat('n/', CAST(note_id AS STRING), '.md#', CAST(i AS STRING)) AS chunk_id, concat('n/', CAST(note_id AS STRING), '.md') AS file_path, concat('Order ', CAST(note_id AS STRING)) AS title, heading, text,
sha256(concat('Order ', CAST(note_id AS STRING), chr(31), heading, chr(31), text)) AS content_hash, start_line, end_line FROM ({_PIECES})"""


def headed(spark, sf_dir) -> DataFrame:
    return spark.sql(HEADED_SQL.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))


def _chunks(spark, sf_dir) -> DataFrame:
    return sections.chunks(headed(spark, sf_dir))


@_query(CHUNKS_SQL)
def chunk_notes(spark, sf_dir):
    return _chunks(spark, sf_dir)


@_query("SELECT concat('e/', CAST(c_custkey AS STRING), '.md#0') AS chunk_id, c_name AS title, '' AS heading, c_name AS text, 1 AS start_line FROM customer")
def chunk_title_only(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.concat(F.lit("e/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.col("c_name").alias("title"), F.lit(" \n").alias("body"))
    return sections.chunks(df).select("chunk_id", "title", "heading", "text", "start_line")


@_query(f"SELECT chunk_id, content_hash, CASE WHEN start_line = 13 THEN 'old' ELSE 'new' END AS embed_model, CASE WHEN start_line = 13 THEN 1 ELSE 4 END AS dim FROM ({CHUNKS_SQL})")
def embed_backfill(spark, sf_dir):
    """Only chunks without a vector are embedded; the others keep theirs."""
    old = F.col("start_line") == 13
    table = _chunks(spark, sf_dir).withColumn("embedding", F.when(old, F.array(F.lit(1.0)))).withColumn("embed_model", F.when(old, F.lit("old")))
    return sections.backfill(table, letter_vectors, "new").select("chunk_id", "content_hash", "embed_model", F.size("embedding").alias("dim"))


@_query(f"SELECT chunk_id, CASE WHEN start_line <> 13 THEN 'm' END AS embed_model, CASE WHEN start_line <> 13 THEN start_line END AS first FROM ({CHUNKS_SQL})")
def embed_reuse(spark, sf_dir):
    """Chunks that moved to another file keep the vector of equal content."""
    new = _chunks(spark, sf_dir)
    old = new.where("start_line <> 13").select("content_hash", F.lit("m").alias("embed_model"), F.array(F.col("start_line").cast("double")).alias("embedding"))
    return sections.reuse(new, old, "m").select("chunk_id", "embed_model", F.col("embedding")[0].cast("int").alias("first"))


_LETTERS = "[length({t})::DOUBLE, (length({t}) - length(replace({t}, 'e', '')))::DOUBLE, (length({t}) - length(replace({t}, 'i', '')))::DOUBLE, (length({t}) - length(replace({t}, 'x', '')))::DOUBLE]"


def _words_of(c: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _hits(c: str, w: str) -> str:
    return f"len(list_filter({_words_of(c)}, lambda x: starts_with(x, '{w}')))"


_HYBRID_TERMS = ("thtion", "attion", "budget", "order")
_HYBRID = f"""
ch AS (SELECT c.*, n.date FROM ({CHUNKS_SQL}) c JOIN ({HEADED_SQL}) n ON c.file_path = n.path WHERE n.date >= '1995-01-01'),
tf AS (SELECT *, len({_words_of('title')}) + len({_words_of('heading')}) + len({_words_of('text')}) AS len,
  {', '.join(f"3.0 * {_hits('title', w)} + 2.0 * {_hits('heading', w)} + {_hits('text', w)} AS t{i}" for i, w in enumerate(_HYBRID_TERMS))} FROM ch),
st AS (SELECT count(*) AS n, avg(len) AS al, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(4))} FROM tf),
bm AS (SELECT chunk_id AS id, {' + '.join(f'ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / al))' for i in range(4))} AS score FROM tf, st WHERE greatest({', '.join(f't{i}' for i in range(4))}) > 0),
ve AS (SELECT chunk_id AS id, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) AS score FROM (SELECT chunk_id, {_LETTERS.format(t='text')} AS e, {_LETTERS.format(t="'thtion attion budget order'")} AS q FROM ch)),
li AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 40 UNION ALL SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM ve QUALIFY r <= 40),
fu AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM li GROUP BY id ORDER BY round(score, 12) DESC, id LIMIT 40)
"""


def _searched(spark, sf_dir) -> DataFrame:
    """Chunks with vectors and dates, written by the first search and read by all others."""
    def build():
        table = sections.chunks(headed(spark, sf_dir), keep=("date",), embed=letter_vectors)
        return _saved(spark, table.drop("content_hash").withColumnRenamed("file_path", "file"), "chunks")

    return kept(spark, "chunks", sf_dir, build)


def _searched_index(spark, sf_dir) -> LexicalIndex:
    def build():
        index = LexicalIndex(spark, Scratch(spark, "chunk-index").path, {"title": 3.0, "heading": 2.0, "text": 1.0})
        index.apply(_searched(spark, sf_dir).withColumnsRenamed({"file": "owner", "chunk_id": "id"}), 0)
        return index

    return kept(spark, "chunk-index", sf_dir, build)


_INDEXED = _HYBRID.replace(" WHERE n.date >= '1995-01-01')", ")", 1).replace("FROM tf, st WHERE", "FROM tf, st WHERE date >= '1995-01-01' AND").replace(" AS q FROM ch)", " AS q FROM ch WHERE date >= '1995-01-01')")


@_query(f"WITH {_INDEXED} SELECT file_path AS file, title, arg_max(heading, (round(score, 9), -start_line)) AS heading, date, round(max(score), 9) AS score, count(*) AS n_chunks FROM ch JOIN fu ON id = chunk_id GROUP BY file_path, title, date ORDER BY max(round(score, 9)) DESC, file LIMIT 20")
def hybrid_indexed(spark, sf_dir):
    """The same search with BM25 from the lexical index of all chunks."""
    out, mode, _ = search.search(spark, _searched(spark, sf_dir), " ".join(_HYBRID_TERMS), embed=lambda q: letter_vectors([q])[0], since="1995-01-01", index=_searched_index(spark, sf_dir))
    assert mode == "hybrid"
    return out.select("file", "title", "heading", "date", F.round("score", 9).alias("score"), F.size("chunks").cast("long").alias("n_chunks"))


@_query(f"WITH {_HYBRID} SELECT file_path AS file, title, arg_max(heading, (round(score, 9), -start_line)) AS heading, date, round(max(score), 9) AS score, count(*) AS n_chunks FROM ch JOIN fu ON id = chunk_id GROUP BY file_path, title, date ORDER BY max(round(score, 9)) DESC, file LIMIT 20")
def hybrid_search(spark, sf_dir):
    """BM25 over title, heading and text, vectors, fusion, date filter, and one row for each note."""
    chunks = _searched(spark, sf_dir)
    out, mode, _ = search.search(spark, chunks, " ".join(_HYBRID_TERMS), embed=lambda q: letter_vectors([q])[0], since="1995-01-01")
    assert mode == "hybrid"
    return out.select("file", "title", "heading", "date", F.round("score", 9).alias("score"), F.size("chunks").cast("long").alias("n_chunks"))


@_query(f"SELECT chunk_id, length(text) AS n FROM ({CHUNKS_SQL}) WHERE file_path = 'n/1.md' OR starts_with(file_path, 'n/1.md/')")
def search_prefix(spark, sf_dir):
    return _chunks(spark, sf_dir).where(P.under(F.col("file_path"), F.lit("/n/./1.md"))).select("chunk_id", F.length("text").alias("n"))


@_query(f"SELECT path, [concat('# ', title), concat('All lines of customer ', CAST(o_custkey AS STRING), ' thtion. ', substr(repeat('shipped ertion; ', 20), 1, 300 - length(concat('All lines of customer ', CAST(o_custkey AS STRING), ' thtion. '))), '…')] AS matches FROM ({HEADED_SQL}) h JOIN orders ON o_orderkey = h.note_id".replace("[concat('# '", "to_json([concat('# '").replace("'…')]", "'…')])"))
def snippet_lines(spark, sf_dir):
    df = headed(spark, sf_dir)
    return df.select("path", F.to_json(F.filter(search.snippets(F.col("body"), "ÓRDER thtion shipped", 2), lambda x: x.isNotNull())).alias("matches"))


@_query("SELECT chunk_id, file AS file, bucket, place FROM (SELECT vec_id AS chunk_id, concat('f', CAST(label AS STRING), '/', CAST(vec_id AS STRING)) AS file, CASE WHEN label = 3 THEN 2 WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS bucket, row_number() OVER (ORDER BY CASE WHEN label = 3 THEN 2 WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN label <> 3 AND vec_id % 3 <> 0 THEN vec_id % 7 END DESC NULLS LAST, vec_id) AS place FROM embeddings)")
def rerank_order(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), F.col("label"), F.lit("/"), F.col("vec_id")).alias("file"), F.col("vec_id").alias("rank"))
    scores = df.where("chunk_id % 3 <> 0").select("file", (F.col("chunk_id") % 7).alias("rerank"))
    return search.rerank_table(df, scores, ("f3",)).select("chunk_id", "file", "bucket", F.col("place").cast("long").alias("place"))


_ASKED = "concat('Réunion ', p_name, ' clé d ', CAST(p_size AS STRING))"


@_query(f"SELECT p_partkey, term, length(term) >= 4 AS prefix FROM (SELECT p_partkey, unnest(list_distinct(list_filter({_words_of(_ASKED)}, lambda w: length(w) > 1))) AS term FROM part)")
def query_terms(spark, sf_dir):
    """Terms of a query for every part."""
    asked = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_ASKED).alias("q"))
    return asked.select("p_partkey", F.inline(search.terms_of(F.col("q"))))


@_query("SELECT p_partkey AS id, 1 AS n FROM part WHERE p_partkey % 2 = 0")
def bm25_folding(spark, sf_dir):
    """Composed and decomposed letters of any script meet the folded query."""
    name = F.when(F.col("p_partkey") % 4 == 0, "Antonín Dvořák").when(F.col("p_partkey") % 2 == 0, "Antonín Dvořák").otherwise("Dvoracek")
    found = search.bm25(_table(spark, sf_dir, "part").select("p_partkey", name.alias("text")), ["dvorak"], id_col="p_partkey")
    return found.select("id", F.lit(1).alias("n"))


# ---- reads ----
@_query(f"SELECT path, body AS content, CAST(NULL AS STRING) AS error, 1 AS n_links FROM ({NOTES_SQL}) ORDER BY path LIMIT 1")
def point_read(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.col("body").alias("content"))
    first = df.agg(F.min("path")).first()[0]
    return listing.read(df, first, links=True).select("path", "content", "error", F.size("links").alias("n_links"))


@_query("SELECT 'agent.md not found' AS content UNION ALL SELECT 'You are here.'")
def agent_context(spark, sf_dir):
    df = notes(spark, sf_dir).select("path", F.col("body").alias("content"))
    return listing.context(df).unionByName(listing.context(edits.write(df, "agent.md", "You are here.")))


@_query(f"SELECT concat('note://files/', path) AS uri, concat('note-', CAST(note_id AS STRING)) AS name FROM ({NOTES_SQL})")
def resources(spark, sf_dir):
    return listing.resources(notes(spark, sf_dir))


@_query(f"SELECT concat('note-', CAST(note_id AS STRING), '.md') AS name, 'file' AS type FROM ({NOTES_SQL}) WHERE starts_with(path, '20_Projects/Perso/C7/') UNION ALL SELECT 'drafts', 'directory'")
def dir_files(spark, sf_dir):
    df = notes(spark, sf_dir).select("path")
    extra = spark.createDataFrame([("20_Projects/Perso/C7/drafts/a.md",), ("20_Projects/Perso/C7/hidden/b.md",)], "path string")
    return listing.directory(df.unionByName(extra), "20_Projects/Perso/C7", deny=["20_Projects/Perso/C7/hidden"])


@_query("SELECT pos, target, resolved IS NOT NULL AS \"exists\", resolved FROM (SELECT 0 AS pos, regexp_extract(body, '\\[\\[([^\\]\\n]+)\\]\\]', 1) AS target, (SELECT m.path FROM {NOTES} m WHERE concat('note-', CAST(m.note_id AS STRING)) = regexp_extract(n.body, '\\[\\[([^\\]\\n]+)\\]\\]', 1)) AS resolved FROM (SELECT * FROM {NOTES} ORDER BY note_id LIMIT 1) n UNION ALL SELECT 1, 'no such note', NULL UNION ALL SELECT 2, concat('20_Projects/x/note-', CAST((SELECT max(note_id) FROM {NOTES}) AS STRING)), (SELECT arg_max(path, note_id) FROM {NOTES}))")
def links_of_text(spark, sf_dir):
    """The links of one text, the first note's with two more, against all notes."""
    df = notes(spark, sf_dir)
    one = df.orderBy("note_id").first()["body"]
    last = df.agg(F.max("note_id")).first()[0]
    out = links.of_text(spark, f"{one} [[no such note#part|x]] [[#here]] [[20_Projects/x/note-{last}]]", df.select("path"))
    return out.select("pos", "target", "exists", "resolved")


@_query(f"SELECT path AS src, concat('20_Projects/Perso/x/', name) AS resolved, 2 AS n FROM (SELECT path, concat('note-', CAST(note_id AS STRING), '.md') AS name FROM ({NOTES_SQL}))".replace("concat('20_Projects/Perso/x/', name) AS resolved", "least(concat('20_Projects/Perso/x/', name), path) AS resolved"))
def links_ambiguous(spark, sf_dir):
    """Two notes of one name: the smaller path is taken and both are listed."""
    df = notes(spark, sf_dir).select("path", "note_id")
    name = F.concat(F.lit("note-"), F.col("note_id").cast("string"))
    both = df.select("path").unionByName(df.select(F.concat(F.lit("20_Projects/Perso/x/"), name, F.lit(".md")).alias("path")))
    found = links.resolve(links.edges(df.select("path", F.concat(F.lit("[[nowhere/"), name, F.lit("]]")).alias("content"))), both)
    return found.select("src", "resolved", F.size("ambiguous").alias("n"))


@_query(f"SELECT path FROM ({NOTES_SQL}) WHERE regexp_matches(path, '^20_Projects/[^/]*/C1[^/]/.*$')")
def glob_match(spark, sf_dir):
    return notes(spark, sf_dir).where(F.rlike("path", F.lit(P.glob_regex(" /20_Projects\\*/C1?/**")))).select("path")


_PLACES = "['20_Projects/Pro', '20_Projects', '20_Projects/Pro/Secret', '10_Context', '20_Projects/Pro/a/../b', '20_Projects/./Pro/Secret2', '../x'][1 + o_orderkey % 7]"


@_query(f"SELECT o_orderkey, o_orderkey % 7 IN (0, 4, 5) AS file_ok, o_orderkey % 7 IN (0, 4, 5) OR (o_orderkey % 7 = 1 AND o_orderkey % 2 = 0) AS browse_ok, o_orderkey % 7 IN (4, 5) OR (o_orderkey % 7 = 0 AND o_orderkey % 2 > 0) AS tree_ok FROM orders WHERE {_PLACES} IS NOT NULL")
def access_paths(spark, sf_dir):
    """Files, folders to browse and whole folders, for every order's place."""
    rows = ["20_Projects/Pro", "20_Projects", "20_Projects/Pro/Secret", "10_Context", "20_Projects/Pro/a/../b", "20_Projects/./Pro/Secret2", "../x"]
    place = F.element_at(F.array(*[F.lit(r) for r in rows]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    path = F.when(F.col("o_orderkey") % 2 == 0, place).otherwise(F.concat(place, F.lit("/"), F.col("o_orderkey").cast("string")))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    allow, deny, p = ["20_Projects/Pro"], ["20_Projects/Pro/Secret"], F.col("path")
    return df.select("o_orderkey", P.can_access_file(p, allow, deny).alias("file_ok"), P.can_access_path(p, allow, deny).alias("browse_ok"), P.can_access_tree(p, allow, deny).alias("tree_ok"))


@_query("SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_custkey % 2 = 0 AS allowed FROM orders")
def access_calls(spark, sf_dir):
    operation = F.element_at(F.array(*map(F.lit, ("read", "patch", "search", "create_token"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    target = F.concat(F.when(F.col("o_custkey") % 2 == 0, "open/").otherwise("closed/"), F.col("o_orderkey").cast("string"))
    calls = _table(spark, sf_dir, "orders").select("o_orderkey", operation.alias("operation"), F.array(target).alias("targets"))
    return access.allowed(calls, {"scopes": ["write"], "path_allow": ["open"], "path_deny": []}).select("o_orderkey", "allowed")


@_query("SELECT c_custkey, c_custkey % 3 >= 1 AS can_write FROM customer")
def scopes(spark, sf_dir):
    held = F.element_at(F.array(*[F.array(F.lit(s)) for s in ("read", "write", "admin")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", P.has_scope(held, "write").alias("can_write"))


_HOSTS = ["10.1.2.3", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "100.64.0.1", "100.128.0.1", "[::1]", "[fe80::1]", "[fd00::1]", "[::ffff:10.0.0.1]", "8.8.8.8", "example.com", "localhost", "[2001:db8::1]"]
_PUBLIC = {"172.32.0.1", "100.128.0.1", "8.8.8.8", "example.com", "[2001:db8::1]"}


@_query(f"SELECT c_custkey, url, ok FROM (SELECT c_custkey, concat(CASE WHEN c_custkey % 11 = 0 THEN 'http' ELSE 'https' END, '://', {_HOSTS}[1 + c_custkey % {len(_HOSTS)}], '/', CAST(c_custkey AS STRING)) AS url, c_custkey % 11 > 0 AND list_contains({sorted(_PUBLIC)}, {_HOSTS}[1 + c_custkey % {len(_HOSTS)}]) AS ok FROM customer)")
def url_guard(spark, sf_dir):
    """An address for every customer, hosts taking turns."""
    host = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (F.col("c_custkey") % len(_HOSTS) + 1).cast("int"))
    url = F.concat(F.when(F.col("c_custkey") % 11 == 0, "http").otherwise("https"), F.lit("://"), host, F.lit("/"), F.col("c_custkey").cast("string"))
    return _table(spark, sf_dir, "customer").select("c_custkey", url.alias("url")).withColumn("ok", P.url_allowed(F.col("url")))


@_query("SELECT path, matches FROM (SELECT concat(coalesce(source, 'none'), '/2026-0', CAST(1 + doc_id % 9 AS STRING), '-01 ', CAST(doc_id AS STRING), '.md') AS path, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'thtion') AND trim(x) <> '')[1]) AS matches, doc_id % 9 AS m, text, source FROM documents) WHERE contains(lower(text), 'thtion') AND m BETWEEN 2 AND 5 AND source IS DISTINCT FROM 'src1' ORDER BY path LIMIT 50")
def grep_dated(spark, sf_dir):
    """Date of the file name and access rules before the cut."""
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/2026-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-01 "), F.col("doc_id").cast("string"), F.lit(".md"))
    df = _table(spark, sf_dir, "documents").select(name.alias("path"), F.col("text").alias("content"))
    return search.grep(df, "THtion", limit=50, since="2026-03-01", before="2026-06-01", deny=["src1"]).select("path", F.col("matches")[0].alias("matches"))


# ---- scalars ----
@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 3 = 0 AS is_real FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "d MMM yyyy"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", spelled.alias("s"))
    return df.select("o_orderkey", T.day_of(F.col("s")).alias("day"), T.is_real_date(F.col("s")).alias("is_real"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def note_dates(spark, sf_dir):
    name = F.concat(F.lit("f/"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n"), F.lit(" x.md"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.name_date(name).alias("date"))


@_query("SELECT o_orderkey, d, coalesce(try_cast(d AS DATE) IS NOT NULL AND length(d) = 10, false) AS ok FROM (SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-'), CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 9 AS STRING) ELSE lpad(CAST(o_orderkey % 35 AS STRING), 2, '0') END) AS d FROM orders)")
def real_dates(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 13 == 0, (F.col("o_orderkey") % 9).cast("string")).otherwise(F.lpad((F.col("o_orderkey") % 35).cast("string"), 2, "0"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), day).alias("d"))
    return df.withColumn("ok", T.is_real_date(F.col("d")))


@_query(f"SELECT path, concat('note://open?vault=My%20Notes&file=', replace(substr(path, 1, length(path) - 3), '/', '%2F')) AS uri FROM ({NOTES_SQL})")
def note_uris(spark, sf_dir):
    return notes(spark, sf_dir).select("path", T.note_uri(F.lit("My Notes"), F.col("path")).alias("uri"))


@_query("SELECT s_suppkey, concat('---', chr(10), 'key: ', CAST(s_suppkey AS STRING), chr(10), 'name: ', s_name, chr(10), 'tags:', chr(10), '- a', chr(10), '---', chr(10)) AS front FROM supplier")
def front_dump(spark, sf_dir):
    raw = F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.array(F.lit("a")).alias("tags")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", json_to_front(raw).alias("front"))


@_query("SELECT vec_id, round(1.0::DOUBLE, 6) AS norm FROM embeddings")
def l2_norms(spark, sf_dir):
    unit = search.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN greatest(least(o_orderkey, 100), 1) WHEN 2 THEN 1 ELSE greatest(least(o_custkey // 10, 100), 0) + CASE WHEN o_custkey < 10 THEN 20 ELSE 0 END END::INT AS size FROM orders")
def page_sizes(spark, sf_dir):
    """Page sizes from free input: words, numbers, negative ones and fractions."""
    key = F.col("o_orderkey")
    given = F.when(key % 4 == 0, F.when(key % 8 == 0, "many")).when(key % 4 == 1, key.cast("string")).when(key % 4 == 2, F.concat(F.lit("-"), key.cast("string"))).otherwise((F.col("o_custkey") / 10).cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", listing.page_size_of(given).alias("size"))


# ---- changes ----
@_query(f"SELECT path, CASE WHEN note_id = (SELECT min(note_id) FROM ({NOTES_SQL})) THEN 'replaced' ELSE body END AS content FROM ({NOTES_SQL}) UNION ALL SELECT 'new.md', 'first' UNION ALL SELECT 'log.md', concat('one', chr(10), 'two')")
def write_and_append(spark, sf_dir):
    df = notes(spark, sf_dir)
    path = df.orderBy("note_id").first()["path"]
    df = edits.write(df.select("path", F.col("body").alias("content")), path, "replaced")
    return edits.append(edits.append(edits.append(df, "new.md", "first"), "log.md", "one"), "log.md", "two")


@_query(f"SELECT concat('---', chr(10), 'title: Order ', CAST(note_id AS STRING), chr(10), 'status: ', json_extract_string(fm_json, '$.status'), chr(10), '---', chr(10), 'new body') AS content FROM (SELECT * FROM ({NOTES_SQL}) ORDER BY note_id LIMIT 1)")
def body_replaced(spark, sf_dir):
    df = notes(spark, sf_dir).select("note_id", "path", F.concat(F.lit("---\n"), F.regexp_extract("fm", r"\A(title: [^\n]*\nstatus: [^\n]*\n)", 1), F.lit("---\n"), F.col("body")).alias("content"))
    path = df.orderBy("note_id").first()["path"]
    return edits.replace_body(df.select("path", "content"), path, "new body").where(F.col("path") == path).select("content")


@_query(f"""SELECT path, CASE WHEN note_id % 40 = 0 THEN 'Access denied' WHEN note_id % 20 = 10 THEN 'Destination exists' WHEN note_id = (SELECT min(note_id) FROM ({NOTES_SQL}) WHERE note_id % 40 = 20) AND path = path THEN NULL END AS error FROM ({NOTES_SQL}) WHERE note_id % 10 = 0 AND note_id % 40 <> 20""")
def move_report(spark, sf_dir):
    """Places outside the root, places that are taken."""
    df = notes(spark, sf_dir)
    taken = df.where("note_id % 10 <> 0").agg(F.min("path")).first()[0]
    to = F.when(F.col("note_id") % 40 == 0, F.lit("../out.md")).otherwise(F.lit(taken))
    moves = df.where("note_id % 10 = 0 AND note_id % 40 <> 20").select("path", to.alias("destination"))
    return edits.move(df.select("path", F.col("body").alias("content")), moves)[1].select("path", "error")


@_query(f"SELECT count(*) AS count, count(*) - 1 AS failed_count FROM ({NOTES_SQL}) WHERE note_id % 40 = 20")
def move_to_one_place(spark, sf_dir):
    df = notes(spark, sf_dir)
    moves = df.where("note_id % 40 = 20").select("path", F.lit("in/one.md").alias("destination"))
    return edits.batch_summary(edits.move(df.select("path", F.col("body").alias("content")), moves)[1])


@_query("SELECT path, CASE WHEN starts_with(path, '../') THEN false ELSE path IN (SELECT DISTINCT concat('20_Projects/Pro/C', CAST(o_custkey AS STRING)) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) END AS already_existed, CASE WHEN starts_with(path, '../') THEN 'Access denied' END AS error FROM (SELECT unnest(['20_Projects/Pro/C1', '20_Projects/Pro/C2', '20_Projects/Pro/C4', '20_Projects/Pro/C7', '20_Projects/Pro/new', '../x']) AS path)")
def folders_created(spark, sf_dir):
    """Some folders of notes, a new one and one outside the root."""
    folders = notes(spark, sf_dir).select(F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("path")).distinct()
    return edits.create_folders(folders, ["20_Projects/Pro/C1", "20_Projects/Pro/C2", "20_Projects/Pro/C4", "20_Projects/Pro/C7", "20_Projects/Pro/new", "../x"])


@_query(f"SELECT path, concat('a.', 'b') AS content FROM ({NOTES_SQL}) WHERE false UNION ALL SELECT path, regexp_replace(body, 'ship', 'send') FROM ({NOTES_SQL}) WHERE contains(body, 'ship')")
def patch_first(spark, sf_dir):
    df = notes(spark, sf_dir).where(F.contains("body", F.lit("ship")))
    return df.select("path", edits.patched(F.col("body"), "ship", "send").alias("content"))


@_query(f"SELECT count(*) AS db_count, (SELECT count(*) FROM ({NOTES_SQL})) AS vault_count, false AS in_sync FROM ({NOTES_SQL}) WHERE note_id % 2 = 0")
def sync_counts(spark, sf_dir):
    df = notes(spark, sf_dir)
    return index.sync_status(df.where("note_id % 2 = 0"), df)


@_query(f"SELECT path FROM ({HEADED_SQL}) WHERE note_id % 3 = 0")
def files_without_chunks(spark, sf_dir):
    df = headed(spark, sf_dir)
    return index.unchunked(df, sections.chunks(df.where("note_id % 3 <> 0")))


@_query(f"SELECT concat(file_path, '|', heading) AS place, embed FROM (SELECT file_path, heading, 1.0::DOUBLE AS embed FROM ({CHUNKS_SQL}) WHERE file_path IN (SELECT path FROM ({HEADED_SQL}) WHERE note_id % 3 = 1) UNION ALL SELECT concat('moved/', file_path), heading, 1.0::DOUBLE FROM ({CHUNKS_SQL}) WHERE file_path IN (SELECT path FROM ({HEADED_SQL}) WHERE note_id % 3 = 2))")
def chunks_after_events(spark, sf_dir):
    """Removed notes lose their chunks, moved ones keep their vectors under the new path."""
    df = headed(spark, sf_dir)
    content = F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\n---\n"), F.col("body"))
    old = sections.chunks(df).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).withColumn("embed_model", F.lit("m"))
    gone = df.where("note_id % 3 <> 1").select(F.lit("unlink").alias("event"), "path", F.lit(None).cast("string").alias("content"), F.lit(1).alias("seq"))
    new = df.where("note_id % 3 = 2").select(F.lit("add").alias("event"), F.concat(F.lit("moved/"), F.col("path")).alias("path"), content.alias("content"), F.lit(1).alias("seq"))
    out = index.apply_chunk_events(old, gone.unionByName(new).withColumn("ts", F.lit("2026-01-01").cast("timestamp")), "m")
    return out.select(F.concat_ws("|", "file_path", "heading").alias("place"), F.col("embedding")[0].cast("double").alias("embed"))


@_query(f"SELECT 'unlink' AS event, path, json_extract_string(fm_json, '$.status') AS status FROM ({NOTES_SQL}) WHERE note_id % 8 = 0")
def last_known_front(spark, sf_dir):
    """Removed notes meet the rules of the front matter that the index still held."""
    store = pipeline.Store(spark, Scratch(spark, "fronts").path, buckets=8)
    df = notes(spark, sf_dir)
    change = lambda rows, event: rows.select(F.lit(event).alias("event"), "path", F.when(F.lit(event) == "add", F.col("content")).alias("content"), F.lit("2026-01-01").cast("timestamp").alias("ts"))
    rules = webhooks.empty(spark)
    for status in "FOP":
        rules = webhooks.create(rules, f"https://hooks.example.com/{status}", "2026-01-01", key=status, frontmatter={"status": status}, events=["unlink"])
    pipeline.batch(store, change(df, "add"), 0)
    pipeline.batch(store, change(df.where("note_id % 8 = 0"), "unlink"), 1, rules, lambda *x: 200, guard=None)
    return store.sent(1).select("event", "path", F.col("webhook_id").alias("status"))


# ---- comments ----
def _commented(spark, sf_dir) -> DataFrame:
    """A note for each conversation turn, with a thread that the writers made."""
    def make(text: str) -> str:
        note = comments.create("Before span after", "span", "first " + text, "ann b", "2026-01-01")
        key = comments.threads(note)[0]["id"]
        return comments.set_status(comments.reply(note, key, text, "bob", "2026-01-02"), key, True)

    made = comments.by_few(make, "string")
    df = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return df.select("conv_id", "turn", F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), "text", made("text").alias("content"))


@_query("SELECT concat('c/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING), '.md') AS path, 'resolved' AS status, 'ann_b' AS created_by, 'span' AS anchored_text, 2 AS n, 'bob' AS second FROM conversations WHERE text IS NOT NULL")
def comments_written(spark, sf_dir):
    out = comments.extract(_commented(spark, sf_dir), folder="c/", status="resolved")
    return out.select("path", "status", "created_by", "anchored_text", F.size("replies").alias("n"), F.col("replies")[1]["author"].alias("second"))


@_query("SELECT conv_id, turn, concat('Before span after', chr(10)) AS content FROM conversations WHERE text IS NOT NULL".replace("concat('Before span after', chr(10))", "'Before span after'"))
def comments_removed(spark, sf_dir):
    gone = comments.by_few(lambda c: comments.remove(c, comments.threads(c)[0]["id"]), "string")
    return _commented(spark, sf_dir).select("conv_id", "turn", gone("content").alias("content"))


@_query("SELECT count(*) AS scanned_count, count(*) FILTER (turn % 2 = 0) AS files_with_comments_count FROM conversations WHERE text IS NOT NULL")
def comments_summary(spark, sf_dir):
    df = _commented(spark, sf_dir)
    return comments.summary(df.withColumn("content", F.when(F.col("turn") % 2 == 0, F.col("content")).otherwise("none here")))


# ---- tokens and rules ----
def _tokens(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.col("c_name").alias("name"), F.sha2(F.concat(F.lit("secret-"), key.cast("string")), 256).alias("hash"), F.array(F.lit("read")).alias("scopes"),
        F.when(key % 3 == 0, "2026-01-31").when(key % 3 == 1, "2026-02-01").alias("expires_at"), F.when(key % 5 == 0, F.lit("2026-01-01").cast("timestamp")).alias("revoked_at"),
    )
    return tokens.empty(spark).unionByName(df, allowMissingColumns=True)


@_query("SELECT CAST(c_custkey AS STRING) AS id, c_custkey % 3 = 0 AS expired FROM customer")
def tokens_public(spark, sf_dir):
    out = tokens.public(_tokens(spark, sf_dir), "2026-02-01")
    assert "hash" not in out.columns
    return out.select("id", "expired")


@_query("SELECT count(*) AS active FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def tokens_active(spark, sf_dir):
    return tokens.active_count(_tokens(spark, sf_dir), "2026-02-01")


@_query("SELECT CAST(c_custkey AS STRING) AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def token_lookup(spark, sf_dir):
    return tokens.authenticate(_tokens(spark, sf_dir), "secret-7", "2026-02-01").select("id", "name")


@_query("SELECT CAST(c_custkey AS STRING) AS id, c_custkey % 5 = 0 OR c_custkey = 7 AS revoked FROM customer")
def token_revoked(spark, sf_dir):
    return tokens.revoke(_tokens(spark, sf_dir), "7", "2026-02-01").select("id", F.col("revoked_at").isNotNull().alias("revoked"))


@_query("SELECT CAST(user_id AS STRING) AS id, min(ts) AS last_used_at FROM events e WHERE date_trunc('minute', ts) = (SELECT max(date_trunc('minute', ts)) FROM events x WHERE x.user_id = e.user_id) GROUP BY user_id")
def token_uses(spark, sf_dir):
    """At most one change of the last use for each minute."""
    uses = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), "ts", F.lit("::1").alias("ip"))
    table = uses.select("id").distinct().select("id", *[F.lit(None).cast(k).alias(c) for c, k in spark.createDataFrame([], TOKENS).drop("id").dtypes])
    return tokens.touch(table, uses).select("id", "last_used_at")


@_query("SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey = 2 THEN 'renamed' ELSE c_name END AS name, c_custkey % 2 = 0 AS has_secret FROM customer WHERE c_custkey <> 3")
def rules_public(spark, sf_dir):
    """A rule of every customer, one renamed, one removed; secrets are never shown."""
    key = F.col("c_custkey")
    made = _table(spark, sf_dir, "customer").select(key.cast("string").alias("id"), F.lit(True).alias("enabled"), F.lit("https://hooks.example.com/").alias("url"), F.col("c_name").alias("name"), F.when(key % 2 == 0, "s").alias("secret"))
    out = webhooks.public(webhooks.remove(webhooks.update(webhooks.empty(spark).unionByName(made, allowMissingColumns=True), "2", "2026-01-02", name="renamed"), "3"))
    assert "secret" not in out.columns
    return out.select("id", "name", "has_secret")


@_query("SELECT 'tokens' AS store, count(*) AS n FROM nation UNION ALL SELECT 'rules', count(*) FROM region UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'broken', 0")
def stores_loaded(spark, sf_dir):
    """Token and rule stores from JSON files; a missing or broken one is empty."""
    at = Scratch(spark, "stores").path
    listed = lambda df: df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))  # noqa: E731  tables of fixed size
    rows = {"tokens": listed(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.sha2(F.col("n_name").cast("binary"), 256).alias("hash"), F.array(F.lit("read")).alias("scopes")))}
    rows["rules"] = listed(_table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit(True).alias("enabled"), F.lit("https://x.example/").alias("url"), F.array(F.lit("add")).alias("events")))
    rows["broken"] = rows["rules"].select(F.substring("value", 1, 20).alias("value"))
    for name, df in rows.items():
        df.coalesce(1).write.mode("overwrite").text(f"{at}/{name}")
    got = {"tokens": tokens.load(spark, f"{at}/tokens"), "rules": webhooks.load(spark, f"{at}/rules"), "missing": tokens.load(spark, f"{at}/none"), "broken": webhooks.load(spark, f"{at}/broken")}
    counted = [df.where("id IS NOT NULL").agg(F.lit(name).alias("store"), F.count("*").alias("n")) for name, df in got.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


_XORED = "unhex(list_aggregate(list_transform(range(64), lambda i: printf('%02x', xor(CASE WHEN 2 * i < length(kx) THEN ('0x' || substr(kx, 2 * i + 1, 2))::INT ELSE 0 END, {n}))), 'string_agg', ''))"


@_query(f"SELECT c_custkey, concat('sha256=', sha256({_XORED.format(n=92)} || unhex(sha256({_XORED.format(n=54)} || encode(c_name))))) AS signature FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN sha256(repeat('key', c_custkey % 50 + 22)) ELSE hex(encode(concat('key', CAST(c_custkey AS STRING)))) END AS kx FROM customer)")
def signatures(spark, sf_dir):
    """HMAC of a text with a secret of every customer; long secrets are hashed first."""
    key = F.col("c_custkey")
    secret = F.when(key % 3 == 0, F.expr("repeat('key', CAST(c_custkey % 50 + 22 AS INT))")).otherwise(F.concat(F.lit("key"), key.cast("string")))
    return _table(spark, sf_dir, "customer").select("c_custkey", deliver.signature_of(secret, F.col("c_name").cast("binary")).alias("signature"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 103 = 0 THEN 'a non-empty list is required' WHEN o_orderkey % 103 > 100 THEN 'at most 100 entries are allowed' END AS error FROM orders")
def batch_sizes(spark, sf_dir):
    """The test of a list of entries, for a list of every order."""
    items = F.when(F.col("o_orderkey") % 103 > 0, F.sequence(F.lit(1), F.col("o_orderkey") % 103))
    return _table(spark, sf_dir, "orders").select("o_orderkey", listing.batch_error(items).alias("error"))


@_query("SELECT wanted, state, mode, warned, n FROM (VALUES ('auto', 'whole', 'hybrid', false), ('auto', 'partial', 'bm25', true), ('semantic', 'whole', 'semantic', false), ('hybrid', 'failing', 'bm25', true), ('bm25', 'partial', 'bm25', false)) AS t(wanted, state, mode, warned), (SELECT least(20, count(*) FILTER (c_mktsegment = 'BUILDING')) AS n FROM customer)")
def search_modes(spark, sf_dir):
    """Searches over all customers as notes: with vectors, with one missing, with a provider that fails."""
    key = F.col("c_custkey").cast("string")
    whole = _table(spark, sf_dir, "customer").select(
        key.alias("chunk_id"), F.concat(F.lit("c/"), key).alias("file"), F.col("c_name").alias("title"), F.lit("").alias("heading"), F.col("c_mktsegment").alias("text"), F.lit(None).cast("string").alias("date"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.1), F.lit(0.5)).alias("embedding"),
    )
    partial = whole.withColumn("embedding", F.when(F.col("chunk_id") != "7", F.col("embedding")))

    def down(query):
        raise ConnectionError("down")

    out = None
    for wanted, state, df, embed in (("auto", "whole", whole, None), ("auto", "partial", partial, None), ("semantic", "whole", whole, None), ("hybrid", "failing", whole, down), ("bm25", "partial", partial, None)):
        rows, mode, warnings = search.search(spark, df, "building", embed=embed or (lambda q: [1.0, 0.5]), mode=wanted)
        one = rows.agg(F.count("*").alias("n")).select(F.lit(wanted).alias("wanted"), F.lit(state).alias("state"), F.lit(mode).alias("mode"), F.lit(any("BM25 only" in w for w in warnings)).alias("warned"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT conv_id, turn, 2 AS n, true AS differ FROM conversations WHERE text IS NOT NULL")
def comment_ids(spark, sf_dir):
    """Two comments on the same words at the same time get different ids."""
    def ids(text: str) -> list[str]:
        once = comments.create(text + " span", "span", "a", "me", "2026-01-01")
        return [t["id"] for t in comments.threads(comments.create(once, "span", "a", "me", "2026-01-01"))]

    made = F.pandas_udf(lambda s: s.map(ids), "array<string>")
    df = _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", made(F.regexp_replace("text", "span", "word")).alias("ids"))
    return df.select("conv_id", "turn", F.size("ids").alias("n"), (F.col("ids")[0] != F.col("ids")[1]).alias("differ"))


# ---- streams, batch by batch ----
_KIND = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END"


def _changes(spark, sf_dir) -> DataFrame:
    content = F.concat(F.lit("---\ntitle: Event "), F.col("event_id"), F.lit("\n---\n# A\n\n- [ ] do "), F.col("event_id"))
    return _table(spark, sf_dir, "events").select(F.expr(_KIND).alias("event"), F.concat(F.lit("u"), F.col("user_id"), F.lit(".md")).alias("path"), content.alias("content"), "ts", F.col("event_id").alias("seq"))


def _in_turns(changes: DataFrame, n: int) -> DataFrame:
    """``changes`` with the ``turn`` that takes them: about equal parts in the order of ``seq``, cut at quantiles and not by one task's window."""
    ends = changes.agg(F.percentile_approx("seq", [i / n for i in range(1, n)])).first()[0] or []
    return changes.withColumn("turn", sum(((F.col("seq") > e).cast("int") for e in ends), F.lit(0)))


_LAST = f"SELECT concat('u', CAST(user_id AS STRING), '.md') AS path, max(event_id) AS last, max_by({_KIND}, event_id) AS kind FROM events GROUP BY user_id"


@_query(f"SELECT path, concat('Event ', CAST(last AS STRING)) AS title, concat('do ', CAST(last AS STRING)) AS task, concat('- [ ] do ', CAST(last AS STRING)) AS chunk FROM ({_LAST}) WHERE kind <> 'unlink'")
def stream_store(spark, sf_dir):
    """Files, tasks and chunks after all events in three batches, a repeated one among them."""
    store = pipeline.Store(spark, Scratch(spark, "store").path, buckets=8)
    changes = _changes(spark, sf_dir)
    cut = _saved(spark, _in_turns(changes, 3), "changes")
    for turn in (0, 1, 1, 2):
        pipeline.batch(store, cut.where(F.col("turn") == turn).drop("turn"), turn)
    files, tasks, chunks = store.load()
    out = files.join(tasks.select(F.col("file_path").alias("path"), F.col("text").alias("task")), "path").join(chunks.select(F.col("file_path").alias("path"), F.col("text").alias("chunk")), "path")
    return out.select("path", "title", "task", "chunk")


@_query(f"SELECT path, 'all' AS webhook_id, kind AS event, CASE WHEN last % 3 = 0 THEN 500 WHEN last % 3 = 1 THEN 404 ELSE 200 END AS status, CASE WHEN last % 3 = 0 THEN 3 ELSE 1 END AS tries, CASE WHEN last % 3 = 0 THEN 'HTTP 500' WHEN last % 3 = 1 THEN 'HTTP 404' END AS error FROM ({_LAST})")
def stream_delivery(spark, sf_dir):
    """Server errors are tried again, other answers are final."""
    last = _changes(spark, sf_dir).groupBy("path").agg(F.max_by(F.struct("event", "ts", "seq"), "seq").alias("e")).select("path", "e.*")
    events = last.select("event", "path", F.to_json(F.struct("seq")).alias("frontmatter"), "ts")
    rules = webhooks.create(webhooks.empty(spark), "https://hooks.example.com/all", "2026-01-01", key="all", secret="s")

    def transport(url, body, headers, timeout):
        import json

        return (500, 404, 200)[json.loads(body)["frontmatter"]["seq"] % 3]

    return deliver.deliver(webhooks.match(events, rules), transport, sleep=lambda s: None).select("path", "webhook_id", "event", "status", "tries", "error")


@_query(f"SELECT path FROM ({NOTES_SQL}) WHERE note_id % 3 <> 1")
def stream_catch_up(spark, sf_dir):
    """What the index holds after a start: new notes added, missing ones removed."""
    store = pipeline.Store(spark, Scratch(spark, "caught").path, buckets=4)
    df = notes(spark, sf_dir).select("note_id", "path", F.col("body").alias("content"), F.lit("2026-01-01").cast("timestamp").alias("mtime"))
    pipeline.catch_up(store, df.where("note_id % 3 <> 0").drop("note_id"), 0)
    pipeline.catch_up(store, df.where("note_id % 3 <> 1").drop("note_id"), 1)
    return store.table("files").select("path")


# ---- dialect ----
def _dialect(name: str, sql: str, oracle: str):
    def run(spark, sf_dir):
        return gate.query(spark, {n: _table(spark, sf_dir, n) for n in ("orders", "customer", "region", "events")}, sql)

    run.__name__ = name
    _query(oracle)(run)


_dialect("sql_date_now", "SELECT date('now', '+7 days') > date('now') AS later, date('now', '-1 month') < date('now') AS earlier, length(date('now')) AS n, count(*) AS past FROM orders WHERE cast(o_orderdate AS string) < date('now') -- it's a remark", "SELECT true AS later, true AS earlier, 10 AS n, count(*) AS past FROM orders")
_dialect("sql_alias_order", "SELECT*FROM(SELECT o_custkey, count(*) AS uses FROM orders GROUP BY o_custkey ORDER BY uses DESC, o_custkey LIMIT 15)x", "SELECT o_custkey, count(*) AS uses FROM orders GROUP BY o_custkey ORDER BY uses DESC, o_custkey LIMIT 15")
_dialect("sql_null_order", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, c_custkey) AS r FROM customer", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END NULLS FIRST, c_custkey) AS r FROM customer")
_dialect("sql_lenient", "SELECT r_regionkey, 1 / (r_regionkey - r_regionkey) AS q, cast(r_name AS int) AS n, CASE WHEN r_name != 'ASIA' OR NULL THEN 1 ELSE 0 END AS other FROM region", "SELECT r_regionkey, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS INT) AS n, CASE WHEN r_name <> 'ASIA' THEN 1 ELSE 0 END AS other FROM region")


@_query("SELECT r_name, r_regionkey FROM region WHERE r_regionkey > 1")
def sql_index_note(spark, sf_dir):
    note = "# Views\n\n## Other\n```sql\nSELECT 1\n```\n\n## Regions\ntext\n```sql\n-- a remark\nSELECT r_name, r_regionkey FROM region WHERE r_regionkey > 1\n```\n```dataview\nLIST\n```\n"
    return gate.run_index(spark, {"region": _table(spark, sf_dir, "region")}, note, " regions ")


@_query("SELECT line FROM (SELECT 0 AS i, concat(rpad('k', max(length(CAST(r_regionkey AS STRING)))::INT, ' '), ' | ', rpad('name', max(length(r_name))::INT, ' ')) AS line FROM region UNION ALL SELECT 1, concat(repeat('-', max(length(CAST(r_regionkey AS STRING)))::INT), '-+-', repeat('-', max(length(r_name))::INT)) FROM region UNION ALL SELECT 2, concat(CAST(r_regionkey AS STRING), ' | ', rpad(r_name, (SELECT max(length(r_name))::INT FROM region), ' ')) FROM region)")
def sql_table_text(spark, sf_dir):
    out = gate.table_text(_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    return spark.createDataFrame([(line,) for line in out.split("\n")], "line string")


@_query(f"SELECT path, CASE WHEN contains(body, '[x]') THEN 1 ELSE 0 END AS completed, regexp_extract(body, 'due:: (\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS due FROM ({NOTES_SQL})")
def sql_table_function(spark, sf_dir):
    udtf.register(spark)
    return spark.sql("SELECT path, t.completed, t.due FROM {n}, LATERAL md_tasks(body) t", n=notes(spark, sf_dir))


@_query(f"SELECT query, count(*) AS hits FROM (SELECT '{WORDS.split()[0]}' AS query, text FROM documents) WHERE len(list_filter({_words_of('text')}, lambda x: starts_with(x, query))) > 0 GROUP BY query")
def bm25_index_hits(spark, sf_dir):
    """The same documents by a written index of postings."""
    path = Scratch(spark, "bm25").path
    search.build_index(_table(spark, sf_dir, "documents"), path)
    word = WORDS.split()[0]
    direct = search.bm25(_table(spark, sf_dir, "documents"), word).withColumnRenamed("score", "direct")
    both = search.bm25_indexed(spark, path, word).join(direct, "id", "full")
    return both.where(F.abs(F.col("score") - F.col("direct")) < 1e-9).groupBy(F.lit(word).alias("query")).agg(F.count("*").alias("hits"))


def _saved(spark, df: DataFrame, name: str) -> DataFrame:
    return Scratch(spark, name).save(df, "rows")
