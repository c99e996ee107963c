"""Retrieval: BM25, exact vector search, rank fusion, collapse to notes, literal and fuzzy search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..scratch import Scratch
from .links import similarity
from .listing import in_range, page_size

K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES = 40
SNIPPET = 300
TILE_MB = 16  # of vectors that travel together
WORDS_AT_ONCE = 1 << 18  # of a batch, when they are counted
TERMS = "terms array<struct<term:string,tf:double>>"


def query_terms(query: str) -> list[tuple[str, bool]]:
    """``(term, also as a prefix)`` of a query: terms of one letter are dropped, those of four or more match as prefixes."""
    words = "".join(c if c.isalnum() else " " for c in T.fold_text(query)).split()
    return [(w, len(w) >= 4) for w in dict.fromkeys(words) if len(w) > 1]


def terms_of(query: Column) -> Column:
    """The same as a column of ``(term, prefix)``, for tables of queries."""
    words = F.filter(F.array_distinct(T.tokens(query)), lambda w: F.length(w) > 1)
    return F.transform(words, lambda w: F.struct(w.alias("term"), (F.length(w) >= 4).alias("prefix")))


_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class _Words:
    """Places of the words, in lower case, in a column of ``T.worded`` texts, found in its bytes."""

    def __init__(self, column: pa.StringArray):
        column = pc.ascii_lower(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.inside = _WORD[self.bytes]
        first, last = self.inside.copy(), self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        filled = np.flatnonzero(np.diff(self.at))  # a text begins and ends its own words
        begin, end = self.at[filled], self.at[filled + 1] - 1
        first[begin], last[end] = self.inside[begin], self.inside[end]
        self.starts = np.flatnonzero(first)
        self.sizes = np.flatnonzero(last) + 1 - self.starts

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(starts, self.at))

    def count(self, term: str, prefix: bool) -> np.ndarray:
        """Words of each text that are the term, or begin with it."""
        raw = term.encode()
        found = self.starts[self.sizes >= len(raw) if prefix else self.sizes == len(raw)]
        for i, b in enumerate(raw):
            found = found[self.bytes[found + i] == b]
        return self.per_text(found)

    def strings(self) -> pa.StringArray:
        ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(self.bytes[self.inside].tobytes()))


def _pieces(batches, fields: int):
    """Slices of batches whose last ``fields`` columns are texts: few words at a time, at eight bytes a word, and always one whole row."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns[-fields:]:
            ends += pc.binary_length(c).to_numpy()
        ends, at = np.cumsum(ends), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * WORDS_AT_ONCE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _worded(docs: DataFrame, keys: list[str], fields: dict[str, float]) -> DataFrame:
    return docs.select(*keys, *[T.worded(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in fields])


def forward(docs: DataFrame, keys: list[str], fields: dict[str, float]) -> DataFrame:
    """``keys, length, terms (term, tf)``: a row for each document, whose words are counted where it is read.

    ``tf`` is weighted by field, ``length`` is the number of words of all fields.  Nothing is
    shuffled; few words at a time are held for counting, however many a batch has.
    """
    weights = [float(w) for w in fields.values()]

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_Words(c) for c in piece.columns[len(keys) :]]
        sizes = [t.per_text(t.starts) for t in texts]
        doc = np.concatenate([np.repeat(np.arange(piece.num_rows), n) for n in sizes])
        weight = np.concatenate([np.full(n.sum(), w) for n, w in zip(sizes, weights)])
        words = pa.concat_arrays([t.strings() for t in texts]).dictionary_encode()
        wide = max(1, len(words.dictionary))
        found, which = np.unique(doc * wide + words.indices.to_numpy().astype(np.int64), return_inverse=True)
        tf = np.bincount(which, weight, len(found))
        at = np.searchsorted(found, np.arange(piece.num_rows + 1) * wide)
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(found % wide)), pa.array(tf, pa.float64())], ["term", "tf"])
        return pa.RecordBatch.from_arrays([*piece.columns[: len(keys)], pa.array(sum(sizes), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), terms)], [*keys, "length", "terms"])

    kinds = ", ".join(f"{k} {dict(docs.dtypes)[k]}" for k in keys)
    return _worded(docs, keys, fields).mapInArrow(lambda batches: map(count, _pieces(batches, len(weights))), f"{kinds}, length long, {TERMS}")


def _counted(docs: DataFrame, fields: dict[str, float], terms: list[tuple[str, bool]]) -> DataFrame:
    """``id, length, tf0, tf1, ...``: how often each document ``(id, fields)`` holds each term, weighted by field; counted where it is read."""
    weights = [float(w) for w in fields.values()]

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_Words(c) for c in piece.columns[1:]]
        length = sum(t.per_text(t.starts) for t in texts)
        tf = [sum(w * t.count(*term) for w, t in zip(weights, texts)) for term in terms]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(length, pa.int64()), *[pa.array(x, pa.float64()) for x in tf]], ["id", "length", *[f"tf{i}" for i in range(len(terms))]])

    kinds = "".join(f", tf{i} double" for i in range(len(terms)))
    return _worded(docs, ["id"], fields).mapInArrow(lambda batches: map(count, _pieces(batches, len(weights))), f"id {dict(docs.dtypes)['id']}, length long{kinds}")


def _matched(docs: DataFrame, fields: dict[str, float], terms: list[tuple[str, bool]]) -> DataFrame:
    """The same for terms that are not words, which only a pattern finds."""

    def counted(s: Column) -> Column:
        length = sum((T.token_count(s[f"_{f}"]) for f in fields), F.lit(0))
        count = lambda t, p: sum((F.lit(float(w)) * T.term_count(s[f"_{f}"], t, p) for f, w in fields.items()), F.lit(0.0))
        return F.struct(length.alias("length"), *[count(*term).alias(f"tf{i}") for i, term in enumerate(terms)])

    # a generator, so that a text is folded and counted once however often the counts are used
    folded = F.struct(*[T.fold(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in fields])
    return docs.select("id", F.inline(F.transform(F.array(folded), counted)))


def _scored(n: Column, average: Column, df: list[Column], k1: float, b: float) -> Column:
    """Okapi BM25 of a row ``(length, tf0, tf1, ...)``; the terms are added in their order, so equal rows score the same."""
    score = F.lit(0.0)
    for i, d in enumerate(df):
        tf = F.col(f"tf{i}")
        score = score + F.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average))
    return score


def bm25(docs: DataFrame, query: str | list[str], *, id_col: str = "doc_id", fields: dict[str, float] | None = None, k1: float = K1, b: float = B, prefixes: bool = True) -> DataFrame:
    """``id, score`` of the documents that hold a query term (Okapi BM25; field weights scale the term counts).

    The terms are few and given, so they are counted where a document is read: only
    ``(id, length, counts per term)`` leave the scan, which is run once and at once, and are
    written for the statistics and the scores to read.  For many queries of one collection
    see :func:`build_index`.
    """
    fields = fields or {"text": 1.0}
    terms = [(t, p and prefixes) for t, p in (query_terms(query) if isinstance(query, str) else [(t, False) for t in query])]
    count = _counted if all(t.isalnum() for t, _ in terms) else _matched
    # fields by position: one may be the id itself
    named = docs.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    rows = Scratch(docs.sparkSession, "bm25").save(count(named, {f"f{i}": w for i, w in enumerate(fields.values())}, terms), "counts")
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    found = rows.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0.0)) > 0 if terms else F.lit(False)).crossJoin(F.broadcast(stats))
    return found.select("id", _scored(F.col("n"), F.col("avg_length"), [F.col(f"df{i}") for i in range(len(terms))], k1, b).alias("score"))


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", fields: dict[str, float] | None = None) -> None:
    """Write ``postings (term, id, tf)``, sorted by term, and ``lengths (id, length)`` below ``path``.

    ``tf`` is weighted by field.  Rows are ranged by term and then by document, so a
    frequent term spreads over files and a query's terms reach few of them.
    """
    fields = fields or {"text": 1.0}
    spark = docs.sparkSession
    words = Scratch(spark, "words").save(forward(docs.select(F.col(id_col).alias("id"), *fields), ["id"], fields), "words")
    words.select("id", "length").write.mode("overwrite").parquet(f"{path}/lengths")
    flat = words.select("id", F.inline("terms")).select("term", "id", "tf")
    flat.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def bm25_indexed(spark: SparkSession, path: str, query: str | list[str], *, k1: float = K1, b: float = B, prefixes: bool = True) -> DataFrame:
    """``id, score`` as :func:`bm25` gives them, from a written index: only postings of the query's terms are read."""
    terms = query_terms(query) if isinstance(query, str) else [(t, False) for t in query]
    hit, which = F.lit(False), F.array().cast("array<int>")
    for i, (t, prefix) in enumerate(terms):
        test = F.startswith("term", F.lit(t)) if prefix and prefixes else F.col("term") == t
        hit, which = hit | test, F.concat(which, F.when(test, F.array(F.lit(i))).otherwise(F.array().cast("array<int>")))
    lengths = spark.read.parquet(f"{path}/lengths")
    found = spark.read.parquet(f"{path}/postings").where(hit).select("id", F.explode(which).alias("q"), "tf").groupBy("id", "q").agg(F.sum("tf").alias("tf"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    df = found.groupBy("q").agg(F.count("*").alias("df"))  # a row for each term of the query
    joined = found.join(F.broadcast(df), "q").join(lengths, "id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return joined.groupBy("id").agg(F.sum(weight).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def vector_scores(vectors: DataFrame, query: list[float], *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, score``: the cosine of every vector with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score"))


def vector_topk(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, score`` of the ``k`` nearest vectors by cosine; each task keeps its own ``k`` best."""
    return vector_scores(vectors, query, id_col=id_col, vec_col=vec_col).orderBy(F.desc("score"), "id").limit(k)


def _number(vectors: DataFrame, vec_col: str) -> str:
    return "float32" if dict(vectors.dtypes)[vec_col] == "array<float>" else "float64"


def _unit(raw: bytes, number: str, rows: int) -> Callable[[int, int], np.ndarray]:
    """Some of the packed vectors as unit vectors in double."""
    matrix = np.frombuffer(raw, number).reshape(rows, -1)

    def some(start: int, stop: int) -> np.ndarray:
        part = matrix[start:stop].astype(np.float64)
        return part / np.linalg.norm(part, axis=1)[:, None]

    return some


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values in falling order, the first of equal ones first."""
    if score.shape[1] <= k:
        return np.argsort(-score, axis=1, kind="stable")
    best = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)
    found = np.take_along_axis(score, best, axis=1)
    best = np.take_along_axis(best, np.argsort(-found, axis=1, kind="stable"), axis=1)
    tied = (score >= found.min(axis=1)[:, None]).sum(axis=1) > k  # a tie at the end: which of them come first has to be looked at
    best[tied] = np.argsort(-score[tied], axis=1, kind="stable")[:, :k]
    return best


def _blocks(vectors: DataFrame, count: int, id_col: str, vec_col: str) -> DataFrame:
    """``block, ids, matrix``: vectors, in the type they have, in ``count`` blocks by hash of the id; null, zero and non-finite vectors are left out."""
    kind, number = dict(vectors.dtypes)[id_col], _number(vectors, vec_col)

    def pack(key, table):
        found = table.column("v").combine_chunks()
        flat = found.flatten().to_numpy(zero_copy_only=False).astype(number)
        sizes = np.diff(found.offsets.to_numpy())
        width = int(sizes.max(initial=0))
        good = np.flatnonzero((sizes == width) & (width > 0))
        matrix = flat.reshape(-1, width) if len(good) == len(sizes) else np.stack([np.resize(found[int(i)].values.to_numpy(zero_copy_only=False), width) for i in good]) if len(good) else np.zeros((0, 0))
        norm = np.concatenate([np.linalg.norm(matrix[i : i + 4096].astype(np.float64), axis=1) for i in range(0, max(1, len(matrix)), 4096)])
        whole = np.isfinite(norm) & (norm > 0)
        ids = table.column("id").combine_chunks().take(pa.array(good[whole]))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(table.schema.field("id").type)), "matrix": pa.array([matrix[whole].astype(number).tobytes()], pa.binary())})

    rows = vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull())).select(F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int").alias("block"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, matrix binary")


def vector_topk_batch(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, rows: tuple[int, int] | None = None) -> DataFrame:
    """``query, id, score, rank``: the ``k`` nearest vectors of every query, itself included, ties by id.

    Both sides are cut into tiles of at most :data:`TILE_MB`, so that each travels few
    times; a pair of tiles is the work of one task, which multiplies ``block`` vectors of
    each at a time and keeps each query's ``k`` best; those of all pairs are merged by
    query.  ``rows`` are the numbers of queries and vectors, if known.
    """
    n_queries, n_vectors = rows or (queries.count(), vectors.count())
    width = vectors.agg(F.max(F.size(vec_col))).first()[0] or 1
    number, other = _number(vectors, vec_col), _number(queries, vec_col)
    # small tables are cut as well, for all cores to have work
    side = max(2, round((4 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    tiles = lambda n, size: max(1, -(-n * width * size // (TILE_MB << 20)), min(side, -(-n // block)))
    left, right = tiles(n_queries, np.dtype(other).itemsize), tiles(n_vectors, np.dtype(number).itemsize)
    a = _blocks(queries, left, id_col, vec_col).select(F.col("ids").alias("queries"), F.col("matrix").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("block"))
    b = _blocks(vectors, right, id_col, vec_col)
    kind = dict(vectors.dtypes)[id_col]

    def product(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                asked, ids = np.array(r["queries"]), np.array(r["ids"])
                if not len(asked) or not len(ids) or len(r["left"]) // (len(asked) * np.dtype(other).itemsize) != len(r["matrix"]) // (len(ids) * np.dtype(number).itemsize):
                    continue
                order = np.argsort(ids, kind="stable")
                x = _unit(r["left"], other, len(asked))
                y = _unit(np.frombuffer(r["matrix"], number).reshape(len(ids), -1)[order].tobytes(), number, len(ids))
                ids = ids[order]
                for i in range(0, len(asked), block):
                    mine, score, place = x(i, i + block), None, None
                    for j in range(0, len(ids), block):
                        new = np.round(mine @ y(j, j + block).T, 9)  # so that equal vectors tie, in whatever tile they are
                        best = _best(new, k)
                        new, best = np.take_along_axis(new, best, axis=1), best + j
                        if score is not None:  # those before have smaller ids
                            new, best = np.concatenate([score, new], axis=1), np.concatenate([place, best], axis=1)
                            first = _best(new, k)
                            new, best = np.take_along_axis(new, first, axis=1), np.take_along_axis(best, first, axis=1)
                        score, place = new, best
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[i : i + block], place.shape[1])), pa.array(ids[place].ravel()), pa.array(score.ravel())], ["query", "id", "score"])

    met = a.join(b, "block").repartition(left * right, F.xxhash64("queries", "block")).mapInArrow(product, f"query {kind}, id {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(scores: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` best of ``scores (id, score)`` with their 1-based ``rank`` in list ``name``."""
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")


def fuse(lists: DataFrame, *, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """``id, score`` and each list's rank and score, of ``lists (id, list, rank, score)``: sum of ``weight / (k + rank)``."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, float(w)).otherwise(weight)
    of = lambda c, name: F.max(F.when(F.col("list") == name, F.col(c)))
    return lists.groupBy("id").agg(F.sum(weight / (k + F.col("rank"))).alias("score"), of("rank", "bm25").alias("bm25_rank"), of("rank", "vector").alias("vector_rank"), of("score", "vector").alias("cosine"))


def collapse(chunks: DataFrame) -> DataFrame:
    """One row per file of ``chunks (file, chunk_id, title, heading, date, score, ...)``: the best chunk's fields and all chunks by score."""
    best = F.max_by(F.struct("title", "heading", "date", "score"), F.struct("score", F.negative(F.col("start_line"))))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), "start_line", "end_line", "heading", "score")))
    out = chunks.groupBy("file").agg(best.alias("b"), F.transform(listed, lambda x: F.struct(x["heading"].alias("heading"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["score"].alias("score"))).alias("chunks"))
    return out.select("file", "b.title", "b.heading", "b.date", "b.score", "chunks")


def snippets(content: Column, query: str, n: int = 3) -> Column:
    """Lines that hold a query term, folded; else the first lines; cut to 300 characters."""
    terms = [t for t, _ in query_terms(query)]
    # the text is folded once and whole: no line end comes or goes by that
    pairs = F.zip_with(F.split(content, "\n"), F.split(T.fold(content), "\n"), lambda x, y: F.struct(F.trim(x).alias("line"), y.alias("folded")))
    hit = lambda y: reduce(lambda a, t: a | F.contains(y, F.lit(t)), terms, F.lit(False))
    lines = F.transform(F.filter(pairs, lambda p: p["line"] != ""), lambda p: F.struct(p["line"].alias("line"), hit(p["folded"]).alias("hit")))
    cut = lambda x: F.when(F.length(x) > SNIPPET, F.concat(F.substring(x, 1, SNIPPET), F.lit("…"))).otherwise(x)

    def chosen(every: Column, found: Column) -> Column:
        return F.slice(F.when(F.size(found) > 0, found).otherwise(every), 1, n)

    # lambdas over one element, so that what both branches use is made once
    best = F.transform(F.array(lines), lambda every: F.transform(F.array(F.filter(every, lambda p: p["hit"])), lambda found: chosen(every, found))[0])[0]
    return F.transform(best, lambda p: cut(p["line"]))


def grep(notes: DataFrame, query: str, *, limit=None, since=None, before=None, allow=None, deny=None, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """``path, matches`` of notes that hold the literal query, case folded; access is tested before the cut."""
    df = notes.where(F.contains(F.lower(F.col(text_col)), F.lit(query.lower())))
    if allow or deny:
        df = df.where(P.can_access_file(F.col(id_col), allow or [], deny or []))
    if since or before:
        df = df.where(in_range(T.name_date(F.col(id_col)), since, before))
    return df.select(id_col, T.matching_lines(F.col(text_col), query).alias("matches")).orderBy(id_col).limit(page_size(limit))


def fuzzy(notes: DataFrame, query: str, *, limit=None, allow=None, deny=None, name: Column | None = None, text: Column | None = None, id_col: str = "path") -> DataFrame:
    """``id, score``: similarity of the name, and 0.3 more where the text holds the query."""
    q = F.lit(query.lower())
    text = F.col("content") if text is None else text
    name = F.lower(T.basename(F.col(id_col)) if name is None else name)
    hit = F.contains(F.lower(F.coalesce(text, F.lit(""))), q)
    score = similarity(name, q) + F.when(hit, 0.3).otherwise(0.0)
    df = notes.where((score > 0.4) | hit)
    if allow or deny:
        df = df.where(P.can_access_file(F.col(id_col), allow or [], deny or []))
    return df.select(F.col(id_col), F.round(score, 2).alias("score")).orderBy(F.desc("score"), id_col).limit(page_size(limit))


def rerank(candidates: list[dict], query: str, scorer: Callable | None, *, wanted: bool = True, restricted: bool = False, exclude: tuple[str, ...] = ()) -> dict:
    """Candidates by the scorer's order, then those it left out, then those it must not see; on failure the order given."""
    if not wanted or scorer is None or restricted:
        return {"ordered": list(candidates), "reranked": 0, "skipped": 0, "error": None}
    hidden = [c for c in candidates if any(c["file"] == p or c["file"].startswith(p.rstrip("/") + "/") for p in exclude)]
    open_ = [c for c in candidates if c not in hidden]
    try:
        scores = scorer(query, [c["text"] for c in open_])
    except Exception as e:
        return {"ordered": list(candidates), "reranked": 0, "skipped": len(hidden), "error": str(e)}
    scored = [(s, i) for i, s in enumerate(scores) if s is not None]
    first = [open_[i] for _, i in sorted(scored, key=lambda x: (-x[0], x[1]))]
    rest = [c for i, c in enumerate(open_) if i not in {j for _, j in scored}]
    return {"ordered": first + rest + hidden, "reranked": len(first), "skipped": len(hidden), "error": None}


def rerank_table(candidates: DataFrame, scores: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``candidates (file, rank, ...)`` with ``bucket`` and ``place``: scored ones by ``scores (file, rerank)``, then unscored ones in their order, then those withheld.

    Candidates of one search are few.  With a column ``query`` there are those of many searches, each placed by itself.
    """
    each = ["query"] if "query" in candidates.columns else []
    hidden = F.lit(False)
    for p in exclude:
        hidden = hidden | (F.col("file") == p) | F.startswith("file", F.lit(p.rstrip("/") + "/"))
    df = candidates.join(scores, [*each, "file"], "left").withColumn("bucket", F.when(hidden, 2).when(F.col("rerank").isNull(), 1).otherwise(0))
    shown = F.when(F.col("bucket") == 0, F.col("rerank"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*each).orderBy("bucket", shown.desc_nulls_last(), "rank")))


def mode_of(wanted: str, ready: bool, provider_error: str | None = None) -> tuple[str, list[str]]:
    """The mode that can run, and what to tell the caller."""
    if wanted in ("bm25", "grep", "fuzzy"):
        return wanted, []
    if ready and not provider_error:
        return ("hybrid" if wanted == "auto" else wanted), []
    why = f"embedding provider failed: {provider_error}" if provider_error else "embeddings are not ready"
    return "bm25", [f"{why}; answered with BM25 only"]


def search(spark: SparkSession, chunks: DataFrame, query: str, *, embed: Callable[[str], list[float]] | None = None, mode: str = "auto", limit=None, since=None, before=None, prefix: str | None = None, allow=None, deny=None, candidates: int = CANDIDATES, rrf_k: int = RRF_K, fields: dict[str, float] | None = None, index=None) -> tuple[DataFrame, str, list[str]]:
    """``(rows, mode, warnings)`` over ``chunks (chunk_id, file, title, heading, text, date, start_line, end_line[, embedding])``.

    Path, access and date filters come first, so every list is full after them.  Vectors
    are used only if every chunk has one.  ``index`` (a ``lexical.LexicalIndex`` of the
    chunks, owned by their files) answers the lexical part without reading texts; BM25's
    statistics are then those of all chunks, else of those that the filters leave.
    """
    df, limited = chunks, bool(prefix or allow or deny or since or before)
    if prefix:
        df = df.where(P.under(F.col("file"), F.lit(prefix)))
    if allow or deny:
        df = df.where(P.can_access_file(F.col("file"), allow or [], deny or []))
    df = df.where(in_range(F.col("date"), since, before))
    vector, error = None, None
    ready = False
    if mode in ("auto", "hybrid", "semantic") and embed is not None and "embedding" in chunks.columns:
        ready = status(chunks).first()["semantic_ready"]
    if ready:
        try:
            vector = embed(query)
        except Exception as e:
            error = str(e)
    mode, warnings = mode_of(mode, ready, error)
    even = lambda scores: scores.select("id", (F.rint(F.col("score") * 1e9) / 1e9).alias("score"))  # noqa: E731  so that equal scores tie, in whatever order they were added
    lists = []
    if mode in ("bm25", "hybrid"):
        if index is not None:
            scores = index.bm25(query, owners=df.select(F.col("file").alias("owner")) if limited else None).select("id", "score")
        else:
            scores = bm25(df, query, id_col="chunk_id", fields=fields or {"title": 3.0, "heading": 2.0, "text": 1.0})
        lists.append(ranked(even(scores), "bm25", candidates))
    if mode in ("semantic", "hybrid"):
        lists.append(ranked(even(vector_scores(df.where("embedding IS NOT NULL"), vector, id_col="chunk_id")), "vector", candidates))
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = fuse(both, k=rrf_k).orderBy(F.desc("score"), "id").limit(candidates)
    # at most ``candidates`` rows, found once: what follows from them reads no list again
    fused = spark.createDataFrame(fused.collect(), fused.schema)
    hits = df.join(F.broadcast(fused), F.col("chunk_id") == F.col("id"))
    hits = Scratch(spark, "search").save(hits, "hits")
    best = hits.withColumn("_one", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"))))
    rows = collapse(best.where("_one = 1"))
    lines = hits.groupBy("file").agg(F.max_by("text", "score").alias("_text")).select(F.col("file").alias("_file"), snippets(F.col("_text"), query).alias("matches"))
    out = rows.join(lines, F.col("file") == F.col("_file")).drop("_file").orderBy(F.desc("score"), "file").limit(page_size(limit))
    return out, mode, warnings


def status(chunks: DataFrame, workers: dict[str, str | None] | None = None) -> DataFrame:
    """``chunks, embedded, pending, semantic_ready``, and a column for each entry of ``workers`` (provider, model, last error, rerank state)."""
    got = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    got = got.withColumn("pending", F.col("chunks") - F.col("embedded"))
    got = got.withColumn("semantic_ready", (F.col("chunks") > 0) & (F.col("pending") == 0))
    return got.withColumns({name: F.lit(value) for name, value in workers.items()}) if workers else got
