"""Column functions over note text: front matter, tags, tasks, links, dates."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript regular expressions see it; Java's \s is ASCII only.
JS_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Fixed patterns of the note format.
TAG = r"(?:^|" + JS_SPACE + r")#([a-zA-Z][a-zA-Z0-9_\-/]*)"
TASK = r"\A" + JS_SPACE + r"*- \[([ xX])\] ([^\n\r\x{2028}\x{2029}]+)\z"
TASK_LOOSE = r"(?U)\A\s*-\s+\[([ xX])\]\s*(.*)\z"
LINK = r"\[\[([^\]\n]+)\]\]"
DAY = r"\d{4}-\d{2}-\d{2}"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A" + JS_SPACE + r"+|" + JS_SPACE + r"+\z", "")


def _front(content: Column, mode: str) -> tuple[Column, Column, Column]:
    """Whether there is front matter, the text after its opening rule, and where in that its closing rule begins (from 1).

    Found by plain search: a pattern over the whole text costs milliseconds for a body of a few thousand characters.
    """
    rest = F.substring(content, F.lit(5), F.length(content))
    at = F.instr(rest, "\n---\n" if mode == "api" else "\n---")
    return F.startswith(content, F.lit("---\n")) & (at > 0), rest, at


def front_matter(content: Column, mode: str = "index") -> Column:
    """YAML text of the front matter, null without one.  ``api`` wants a line end after the closing rule."""
    found, rest, at = _front(content, mode)
    return F.when(found, F.substring(rest, F.lit(1), at - 1))


def body(content: Column, mode: str = "index") -> Column:
    """Text after the front matter, or all of it without one."""
    found, rest, at = _front(content, mode)
    ended = F.lit(True) if mode == "api" else F.substring(rest, at + 4, F.lit(1)) == "\n"
    return F.when(found, F.substring(rest, at + F.when(ended, 5).otherwise(4), F.length(content))).otherwise(content)


def inline_tags(text: Column) -> Column:
    """``#tags`` in order of appearance, repeats included; code blocks count."""
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(1))


def all_tags(front: Column, text: Column) -> Column:
    """Front-matter tags, then inline ones, each once in first-seen order."""
    return F.array_distinct(F.concat(F.coalesce(front, F.array().cast("array<string>")), inline_tags(text)))


def task_lines(text: Column) -> Column:
    """``array<struct<pos, text, completed, due>>`` of the task lines of a body."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda x: F.rlike(x["line"], F.lit(TASK)))
    parts = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), F.regexp_extract(x["line"], TASK, 1).alias("mark"), js_trim(F.regexp_extract(x["line"], TASK, 2)).alias("text")))
    return F.transform(parts, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), x["mark"].isin("x", "X").cast("int").alias("completed"), due_date(x["text"]).alias("due")))


def due_date(text: Column) -> Column:
    """The date after a calendar sign, else after ``due::``; null without one."""
    day = lambda mark, pattern: F.when(F.contains(text, F.lit(mark)), F.get(F.regexp_extract_all(text, F.lit(pattern + JS_SPACE + "*(" + DAY + ")"), F.lit(1)), F.lit(0)))
    return F.coalesce(day("📅", "📅"), day("due::", r"\bdue::"))


def loose_tasks(content: Column, isolate_tags: bool = False) -> Column:
    """``array<struct<line, completed, text, tags>>`` over the whole content; ``isolate_tags`` lifts ``[…]`` groups out of the text."""
    lines = F.transform(F.split(content, "\n"), lambda line, i: F.struct((i + 1).alias("line"), F.rlike(line, F.lit(TASK_LOOSE)).alias("ok"), F.regexp_extract(line, TASK_LOOSE, 1).isin("x", "X").alias("completed"), F.trim(F.regexp_extract(line, TASK_LOOSE, 2)).alias("text")))
    kept = F.filter(lines, lambda x: x["ok"])
    if not isolate_tags:
        return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["completed"].alias("completed"), x["text"].alias("text")))
    squeeze = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), r"\s+", " "))
    return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["completed"].alias("completed"), squeeze(x["text"]).alias("text"), F.regexp_extract_all(x["text"], F.lit(r"\[([^\]]*)\]"), F.lit(1)).alias("tags")))


def link_targets(text: Column) -> Column:
    """``array<struct<raw, target>>`` of the wikilinks: the part before ``|`` and ``#``, trimmed; empty ones are dropped."""
    raw = F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    target = lambda x: js_trim(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))
    return F.filter(F.transform(raw, lambda x: F.struct(x.alias("raw"), target(x).alias("target"))), lambda x: x["target"] != "")


def day_of(value: Column) -> Column:
    """A date value as ``YYYY-MM-DD``: the leading ten characters if they have that shape, else common spelled forms, else null."""
    s = F.trim(value)
    forms = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/MM/dd")
    spelled = F.coalesce(*[F.date_format(F.try_to_timestamp(s, F.lit(f)), "yyyy-MM-dd") for f in forms])
    return F.when(F.rlike(s, F.lit(rf"\A{DAY}")), F.substring(s, 1, 10)).when(s != "", spelled)


def is_real_date(value: Column) -> Column:
    """A ``YYYY-MM-DD`` text that names a day of the calendar."""
    return F.coalesce(F.rlike(value, F.lit(rf"\A{DAY}\z")) & F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).isNotNull(), F.lit(False))


def basename(path: Column) -> Column:
    """File name without folders and ``.md``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")


def name_date(path: Column, whole_path: bool = False) -> Column:
    """Date at the start of the file name, or of the whole path."""
    start = path if whole_path else F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(start, rf"\A({DAY})", 1), F.lit(""))


@lru_cache(1)
def _folding() -> tuple[str, str, str]:
    """Marked letters, the letters that they become, and the combining marks that go: all of the basic plane, by rule."""
    marked, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0xD800)):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(bare) == 1 and bare != c and c == c.lower():
            marked.append(c)
            plain.append(bare)
    return "".join(marked), "".join(plain), "".join(marks)


def fold(text: Column) -> Column:
    """Lower case without diacritics, composed or not; texts of ASCII alone skip the table."""
    marked, plain, marks = _folding()
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, marked + marks, plain))


def worded(text: Column) -> Column:
    """A text whose words can be told from its bytes: folded, and of what is not ASCII only letters and digits; texts of ASCII alone stay as they are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def fold_text(text: str) -> str:
    """The same for a value."""
    marked, plain, marks = _folding()
    return text.lower().translate(str.maketrans(marked, plain, marks))


def tokens(text: Column) -> Column:
    """Words of letters and digits, folded."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


WORD_CLASS = r"[\p{L}\p{N}]"


def token_count(folded: Column) -> Column:
    """Number of words of a folded text."""
    return F.regexp_count(folded, F.lit(WORD_CLASS + "++"))


def term_count(folded: Column, term: str, prefix: bool) -> Column:
    """Occurrences of a word, or of all words that begin with it, in a folded text.

    The pattern begins with the word itself, so most places fail at their first
    letter; what stands before it is looked at only where the word is.  Most texts
    don't hold it at all, which a plain search tells.
    """
    word, end = rf"\Q{term}\E", "" if prefix else f"(?!{WORD_CLASS})"
    return F.when(F.contains(folded, F.lit(term)), F.regexp_count(folded, F.lit(f"{word}(?<!{WORD_CLASS}{word}){end}"))).when(folded.isNotNull(), F.lit(0))


def note_uri(vault: Column, path: Column, scheme: str = "note") -> Column:
    """Link that opens a note in a client which answers to ``scheme``; blanks are percent-encoded."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{scheme}://open?vault="), enc(vault), F.lit("&file="), enc(F.regexp_replace(path, r"\.md\z", "")))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    return F.when(needle == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def matching_lines(text: Column, query: str, limit: int = 3) -> Column:
    """Trimmed lines that hold the query, case folded; at most ``limit``."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lit(query.lower())) & (F.trim(x) != ""))
    return F.slice(F.transform(lines, lambda x: F.trim(x)), 1, limit)
