"""Comment threads inside notes: read them, and write them without touching the rest of a note."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


# Fixed forms of the comment format.
MARK = "<!--co:"  # opens a thread: id, header fields, a line end, one entry a line, then the close
CLOSE = "-->"
ID = re.compile(r"[\w-]+")
OPEN = re.compile(r"<!--c:([\w-]+)-->")
FIELD = re.compile(r'\s+(by|at|status|quote):("(?:[^"\\]|\\.)*"|\S+)', re.DOTALL)
ENTRY = re.compile(r"(?P<author>.+?) \((?P<at>[^)]+)\):\s?(?P<text>.*)")
HEADER = ("by", "at", "status", "quote")  # in this order
_ESCAPES = {"\\n": "\n", "\\r": "\r", "\\\\": "\\"}


@dataclass
class Block:
    """A thread as it stands in a note: where it lies, where its header's values lie, and where its entries begin."""

    key: str
    start: int
    end: int
    head_end: int  # the line end after the header
    fields: dict[str, tuple[int, int]]

    def value(self, content: str, name: str) -> str:
        return content[slice(*self.fields[name])].strip('"' if name == "quote" else "")

    def entries(self, content: str) -> str:
        return content[self.head_end + 1 : self.end - len(CLOSE)]

    @property
    def complete(self) -> bool:
        return tuple(self.fields) == HEADER


def blocks(content: str) -> Iterator[Block]:
    """The threads of a note in order, those with an incomplete header included."""
    at = content.find(MARK)
    while at >= 0:
        key = ID.match(content, at + len(MARK))
        stop = content.find("\n", at)
        if key and stop >= 0:
            fields, here = {}, key.end()
            while (m := FIELD.match(content, here)) and m[1] not in fields:
                fields[m[1]], here = m.span(2), m.end()
            line = content.find("\n", here) if tuple(fields) == HEADER else stop
            end = content.find(CLOSE, max(line, 0))
            if 0 <= line < end and CLOSE not in content[here:line]:
                yield Block(key[0], at, end + len(CLOSE), line, fields)
                at = content.find(MARK, end)
                continue
        at = content.find(MARK, at + 1)


def anchors(content: str) -> dict[str, str]:
    """The text between each pair of anchor marks; of several pairs of one id the last counts."""
    spans, at = {}, 0
    while m := OPEN.search(content, at):
        closed = content.find(f"<!--/c:{m[1]}{CLOSE}", m.end())
        if closed >= 0:
            spans[m[1]] = content[m.end() : closed].strip()
        at = max(closed, m.end())
    return spans


_REPLY = StructType()
for _name in ("author", "at", "text"):
    _REPLY = _REPLY.add(_name, StringType())
_THREAD = StructType()
for _name in ("id", "status", "quote", "created_by", "created_at", "anchored_text"):
    _THREAD = _THREAD.add(_name, StringType())
_THREAD = _THREAD.add("replies", ArrayType(_REPLY))


def escape(text: str) -> str:
    return re.sub(r"[\\\n\r]", lambda m: {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[nr\\]", lambda m: _ESCAPES[m[0]], text)


def _safe(text: str) -> str:
    return text.replace("-->", "--\u200b>")


def threads(content: str | None) -> list[dict]:
    """All threads of a note, with the text that each is anchored to."""
    if not content or MARK not in content:
        return []
    spans, out = anchors(content), []
    for b in blocks(content):
        if b.complete and not content[b.fields["quote"][1] : b.head_end].strip():
            said = [ENTRY.fullmatch(line.strip()) for line in b.entries(content).split("\n")]
            replies = [m.groupdict() | {"text": unescape(m["text"])} for m in said if m]
            by, at, status, quote = (b.value(content, name) for name in HEADER)
            out.append({"id": b.key, "status": status, "quote": quote, "created_by": by, "created_at": at, "anchored_text": spans.get(b.key), "replies": replies})
    return out


AT_ONCE = 256  # notes


def by_few(work: Callable, kind: DataType | str):
    """A column function that runs ``work`` on each text, few of them as Python values at a time, however many a batch has."""
    arrow = to_arrow_type(DataType.fromDDL(kind) if isinstance(kind, str) else kind)

    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, AT_ONCE).to_pylist() for at in range(0, len(texts), AT_ONCE))
        return pa.concat_arrays([pa.array([], arrow), *(pa.array([work(x) for x in part], arrow) for part in parts)])

    return F.arrow_udf(run, kind)


def parse(content: Column | str) -> Column:
    return by_few(threads, ArrayType(_THREAD))(content)


def extract(notes: DataFrame, *, path: str | None = None, paths: list[str] | None = None, folder: str | None = None, status: str | None = None) -> DataFrame:
    """``path`` and the fields of each thread; exactly one of the three selectors; ``folder`` selects by substring.

    Only notes that hold a thread mark reach the parser.
    """
    if sum(x is not None for x in (path, paths, folder)) != 1:
        raise ValueError("give exactly one of path, paths and folder")
    chosen = F.col("path") == path if path is not None else F.col("path").isin(paths) if paths is not None else F.contains("path", F.lit(folder))
    rows = notes.where(chosen & F.contains("content", F.lit(MARK))).select("path", F.inline(parse("content")))
    return rows.where(F.col("status") == status) if status else rows


def summary(notes: DataFrame) -> DataFrame:
    """``scanned_count, files_with_comments_count``."""
    return notes.agg(F.count("*").alias("scanned_count"), F.count_if(F.size(parse("content")) > 0).alias("files_with_comments_count"))


def new_id(content: str, quote: str, at: str) -> str:
    """An id of five characters that the note does not hold yet, from a hash of what is commented."""
    taken, turn = set(re.findall(r"<!--(?:c|/c|co):([A-Za-z0-9]+)", content)), 0
    while True:
        number = int.from_bytes(hashlib.sha256(f"{quote}\0{at}\0{turn}".encode()).digest()[:8])
        name = ""
        for _ in range(5):
            number, digit = divmod(number, 36)
            name += "0123456789abcdefghijklmnopqrstuvwxyz"[digit]
        if name not in taken:
            return name
        turn += 1


def _entry(author: str, at: str, text: str) -> str:
    return f"{author} ({at}): {_safe(escape(text))}"


def _author(name: str) -> str:
    return _safe("_".join(name.split()))


def create(content: str, quote: str, text: str, author: str, at: str) -> str:
    """A thread anchored to the first place of the quote."""
    if not quote or quote not in content:
        raise ValueError("quote not found")
    key, who = new_id(content, quote, at), _author(author)
    shown = _safe(" ".join(quote.split()).replace('"', "'"))
    block = f'<!--c:{key}{CLOSE}{quote}<!--/c:{key}{CLOSE}\n{MARK}{key} by:{who} at:{at} status:open quote:"{shown}"\n{_entry(who, at, text)}\n{CLOSE}'
    before, _, after = content.partition(quote)
    return before + block + after


def _block(content: str, key: str) -> Block:
    for b in blocks(content):
        if b.key == key:
            return b
    raise ValueError("comment not found")


def reply(content: str, key: str, text: str, author: str, at: str) -> str:
    """One more entry at the end of the thread."""
    b = _block(content, key)
    lines = [x for x in (b.entries(content).strip("\n"), _entry(_author(author), at, text)) if x]
    return content[: b.head_end + 1] + "\n".join([*lines, ""]) + content[b.end - len(CLOSE) :]


def set_status(content: str, key: str, resolved: bool) -> str:
    """The thread's status; a thread that has it already stays as it is."""
    b, wanted = _block(content, key), "resolved" if resolved else "open"
    if "status" not in b.fields:
        return content if not resolved else f"{content[: b.head_end]} status:{wanted}{content[b.head_end :]}"
    if (b.value(content, "status") == "resolved") == resolved:
        return content
    start, end = b.fields["status"]
    return content[:start] + wanted + content[end:]


def remove(content: str, key: str) -> str:
    """The thread and its marks taken out; the text that it was anchored to stays."""
    b = _block(content, key)
    start = b.start - content.endswith("\n", 0, b.start)
    rest = content[:start] + content[b.end :]
    return rest.replace(f"<!--c:{key}{CLOSE}", "").replace(f"<!--/c:{key}{CLOSE}", "")


def rewrite(notes: DataFrame, path: str, change: Callable[[str], str]) -> DataFrame:
    """``notes`` with one note's content run through one of the writers above."""
    udf = by_few(change, StringType())
    one = notes.where(F.col("path") == path).withColumn("content", udf("content"))
    return notes.where(F.col("path") != path).unionByName(one)
