"""Table functions for SQL: ``SELECT * FROM notes, LATERAL md_links(content)``.

In DataFrames the column functions of :mod:`marklake.functions.text` do the same
without Python; these are for SQL users.
"""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

_LINK = re.compile(r"\[\[([^\]\n]+)\]\]")
_TASK = re.compile(r"\s*- \[([ xX])\] ([^\n\r\u2028\u2029]+)")
_DUE = (re.compile(r"📅\s*(\d{4}-\d{2}-\d{2})"), re.compile(r"\bdue::\s*(\d{4}-\d{2}-\d{2})"))


class MdLinks:
    def eval(self, content: str):
        for raw in _LINK.findall(content or ""):
            target = raw.split("|", 1)[0].split("#", 1)[0].strip()
            if target:
                yield raw, target


class MdTasks:
    def eval(self, content: str):
        for pos, line in enumerate((content or "").split("\n")):
            if m := _TASK.fullmatch(line):
                text = m[2].strip()
                due = next((d[1] for r in _DUE if (d := r.search(text))), None)
                yield pos, text, int(m[1] != " "), due


class MdChunks:
    def eval(self, body: str):
        from ..operators.sections import chunk

        for c in chunk(body or ""):
            yield c["heading"], c["text"], c["start_line"], c["end_line"]


class MdComments:
    def eval(self, content: str):
        from ..operators.comments import threads

        for t in threads(content):
            for r in t["replies"] or [{"author": None, "at": None, "text": None}]:
                yield t["id"], t["status"], t["quote"], t["anchored_text"], r["author"], r["at"], r["text"]


def register(spark) -> None:
    """Make the four functions known to a session."""
    for name, cls, schema in (
        ("md_links", MdLinks, "raw string, target string"),
        ("md_tasks", MdTasks, "pos int, text string, completed int, due string"),
        ("md_chunks", MdChunks, "heading string, text string, start_line int, end_line int"),
        ("md_comments", MdComments, "id string, status string, quote string, anchored_text string, author string, at string, text string"),
    ):
        spark.udtf.register(name, udtf(cls, returnType=schema))
