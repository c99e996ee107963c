"""Sections and chunks of note bodies, and embedding backfill, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MIN_CHARS, OVERLAP = 2200, 200, 300
AT_ONCE, TEXT_AT_ONCE = 256, 1 << 20  # notes, characters of their bodies
BATCH = 32  # texts that are embedded at once
_CHUNK = ("chunk_id", "file_path", "title", "heading", "text", "content_hash", "start_line", "end_line")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")


@lru_cache(4096)
def _heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.fullmatch(line)
    return m and (len(m[1]), m[2])


def split_sections(text: str) -> list[dict]:
    """``{heading, lines, start}``: headings as breadcrumbs; ``#`` inside fences is text; empty sections are dropped."""
    trail: list[tuple[int, str]] = []
    lines: list[str] = []
    sections = [{"heading": "", "lines": lines, "start": 1}]
    fenced = False
    for number, line in enumerate(text.split("\n"), 1):
        if (line[:1] in ("`", "~") or line[:1].isspace()) and line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif line[:1] == "#" and not fenced and (found := _heading(line)):
            trail = [x for x in trail if x[0] < found[0]] + [found]
            lines = []
            sections.append({"heading": " > ".join([t for _, t in trail]), "lines": lines, "start": number + 1})
            continue
        lines.append(line)
    return [s for s in sections if not "".join(s["lines"]).isspace() and any(s["lines"])]


def _paragraphs(section: dict, most: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """``(text, first line, last line)`` of blank-line separated paragraphs; too long ones are cut with an overlap."""
    block, first = [], 0
    lines = [*section["lines"], ""]
    for i, line in enumerate(lines):
        if line.strip():
            if not block:
                first = section["start"] + i
            block.append(line)
        elif block:
            text, last = "\n".join(block), section["start"] + i - 1
            if len(text) <= most:
                yield text, first, last
            else:
                step = max(1, most - min(overlap, most // 2))
                for at in range(0, len(text), step):
                    yield text[at : at + most], first, last
                    if at + most >= len(text):
                        break
            block = []


def chunk(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap_chars: int = OVERLAP) -> list[dict]:
    """``{text, heading, start_line, end_line}``: paragraphs packed up to ``max_chars``; small neighbours across sections are merged."""
    out: list[dict] = []
    for section in split_sections(text):
        own: list[dict] = []
        for piece, first, last in _paragraphs(section, max_chars, overlap_chars):
            if own and len(own[-1]["text"]) + 2 + len(piece) <= max_chars:
                own[-1]["text"] += "\n\n" + piece
                own[-1]["end_line"] = last
            else:
                own.append({"text": piece, "heading": section["heading"], "start_line": first, "end_line": last})
        for c in own:
            small = out and min(len(c["text"]), len(out[-1]["text"])) < min_chars
            if small and len(out[-1]["text"]) + 2 + len(c["text"]) <= max_chars:
                out[-1]["text"] += "\n\n" + c["text"]
                out[-1]["end_line"] = c["end_line"]
            else:
                out.append(c)
    return out


def content_hash(title: str, heading: str, text: str) -> str:
    return hashlib.sha256("\x1f".join((title, heading, text)).encode()).hexdigest()


def chunks(notes: DataFrame, keep: tuple[str, ...] = (), embed: Callable[[list[str]], list[list[float]]] | None = None, **options: int) -> DataFrame:
    """Chunks of ``notes (path, title, body)``; a note without body gives one chunk of its title.

    Each chunk gets its note's columns ``keep`` as well, so nothing of the note has to be joined to its texts,
    and with ``embed`` its vector in ``embedding``, made where the text is cut, :data:`BATCH` texts at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, titles, bodies = batch.columns[:3]
            titles = titles.cast(pa.string()).fill_null("")
            rows, held, of = [], 0, []
            for at in range(batch.num_rows):  # few notes as Python values at a time, however many or long ones a batch has
                path, title, body = paths[at].as_py(), titles[at].as_py(), bodies[at].as_py() or ""
                for i, c in enumerate(chunk(body, **options) or [{"text": title, "heading": "", "start_line": 1, "end_line": 1}]):
                    rows.append((f"{path}#{i}", c["heading"], c["text"], content_hash(title, c["heading"], c["text"]), c["start_line"], c["end_line"]))
                    of.append(at)
                held += len(body)
                if (at + 1) % AT_ONCE == 0 or held >= TEXT_AT_ONCE or at + 1 == batch.num_rows:
                    ids, headings, texts, hashes, first, last = zip(*rows)
                    place = pa.array(of)
                    more = [c.take(place) for c in batch.columns[3:]]
                    if embed:
                        more.append(_embedded(texts, embed, BATCH))
                    made = [pa.array(ids, pa.string()), paths.take(place), titles.take(place), *[pa.array(c, pa.string()) for c in (headings, texts, hashes)], pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*made, *more], [*_CHUNK, *names])
                    rows, held, of = [], 0, []

    names = [*keep, "embedding"] if embed else keep
    kinds = "".join(f", {c} {dict(notes.dtypes)[c]}" for c in keep) + (", embedding array<double>" if embed else "")
    return notes.select("path", "title", "body", *keep).mapInArrow(work, "chunk_id string, file_path string, title string, heading string, text string, content_hash string, start_line int, end_line int" + kinds)


def reuse(new: DataFrame, old: DataFrame, model: str) -> DataFrame:
    """``new`` chunks with the vectors of equal content that ``old (content_hash, embed_model, embedding)`` holds for the model.

    Both sides may be of any size, and sizes guessed from a plan of made texts are far too small: they are sorted and merged, never broadcast.
    """
    known = old.where((F.col("embed_model") == model) & F.col("embedding").isNotNull()).groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
    return new.join(known.hint("merge"), "content_hash", "left").withColumn("embed_model", F.when(F.col("embedding").isNotNull(), F.lit(model)))


def checked(vectors: list, texts: list) -> list:
    """The vectors, if there is one for each text; an answer of another length can't be matched with its texts."""
    if len(vectors) != len(texts):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    return vectors


def asymmetric(embed: Callable[[list[str]], list[list[float]]], query: str = "query: ", passage: str = "passage: ") -> tuple[Callable[[str], list[float]], Callable[[list[str]], list[list[float]]]]:
    """``(of a query, of passages)`` for models that want to be told which of the two they read."""
    return lambda q: checked(embed([query + q]), [q])[0], lambda texts: checked(embed([passage + t for t in texts]), texts)


class Retry(Exception):
    """An answer that may come out well later; ``after`` are seconds to wait, if the other side named them."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retry(call: Callable, tries: int = 5, first: float = 5.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; :class:`Retry` is tried again with doubling waits, other errors are final."""
    for turn in range(tries):
        try:
            return call()
        except Retry as e:
            if turn == tries - 1:
                raise
            sleep(e.after if e.after is not None else min(most, first * 2**turn))


def _embedded(texts: Sequence[str], embed: Callable[[list[str]], list[list[float]]], batch: int) -> pa.Array:
    parts = [list(texts[i : i + batch]) for i in range(0, len(texts), batch)]
    return pa.concat_arrays([pa.array(checked(with_retry(lambda part=part: embed(part)), part), pa.list_(pa.float64())) for part in parts])


def backfill(table: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, batch: int = BATCH, prefix: str = "") -> DataFrame:
    """``table`` with vectors for the chunks that lack one; ``embed`` runs on the executors, ``batch`` texts at a time.

    The table is read once, and only texts without a vector leave it for Python.
    """
    lacks = F.col("embedding").isNull()

    def work(texts: pa.Array, open_: pa.Array) -> pa.Array:
        at, done = np.flatnonzero(open_.to_numpy(zero_copy_only=False)), []
        for i in range(0, len(at), batch):
            part = texts.take(pa.array(at[i : i + batch])).to_pylist()
            done.append(pa.array(checked(with_retry(lambda part=part: embed([prefix + t for t in part])), part), pa.list_(pa.float64())))
        place = np.full(len(texts), -1)
        place[at] = np.arange(len(at))
        made = pa.concat_arrays([*done, pa.array([None], pa.list_(pa.float64()))])  # the last one stands for the rows that keep theirs
        return made.take(pa.array(np.where(place < 0, len(at), place)))

    made = F.arrow_udf(work, "array<double>").asNondeterministic()  # never run twice for one row
    vector = made(F.when(lacks, F.col("text")), lacks).cast(dict(table.dtypes)["embedding"])
    return table.withColumns({"_made": vector, "embed_model": F.when(lacks, F.lit(model)).otherwise(F.col("embed_model"))}).withColumn("embedding", F.coalesce("embedding", "_made")).select(*table.columns)
