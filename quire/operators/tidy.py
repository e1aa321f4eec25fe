"""Tidying of text taken from books: broken lines, style marks, footnote marks and titles."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..functions import text as X

HAN_END, HAN_START = re.compile("[㐀-鿿]$"), re.compile("^[㐀-鿿]")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def join_lines(text: str, least: int = 30) -> str:
    """Joins a line of ``least`` characters or more that ends in a Han character with a next one that starts with one."""
    out: list[str] = []
    size = 0  # of the last line as it stood
    for line in text.split("\n"):
        if out and size >= least and HAN_END.search(out[-1]) and HAN_START.search(line):
            out[-1] += line
        else:
            out.append(line)
        size = len(line)
    return "\n".join(out)


@arrow_udf(T.StringType())
def joined_lines(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else join_lines(x) for x in c.to_pylist()], pa.string())


def mark_styles(c, templates: dict[str, str], default: str = "$1"):
    """Column: ``[x]{.code}`` by the code's template, in which ``$1`` is x; others by the default."""
    for code, template in templates.items():
        c = F.regexp_replace(c, rf"\[([^\[\]]*)\]\{{\.{re.escape(code)}\}}", template)
    return F.regexp_replace(c, r"\[([^\[\]]*)\]\{\.[\w-]+\}", default)


def style_log(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, code, marked`` of every style mark."""
    hits = F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]\{\.[\w-]+\}"), F.lit(0))
    return docs.select(key, F.posexplode(hits).alias("pos", "hit")).select(key, "pos", F.regexp_extract("hit", r"\{\.([\w-]+)\}", 1).alias("code"), F.regexp_extract("hit", r"^\[([^\[\]]*)\]", 1).alias("marked"))


def footnote_lists(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, line_no, line``: items of numbered lists become footnotes with letters, then numbers past the alphabet.

    A list ends at a line that is neither blank nor an item; blank lines don't end it.
    """
    item = F.col("line").rlike(r"^\s*\d+[.、．]\s*\S")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = lines.withColumn("item", item).withColumn("list", F.sum(F.when(~item & (F.trim("line") != ""), 1).otherwise(0)).over(w))
    r = r.withColumn("n", F.sum(F.col("item").cast("int")).over(Window.partitionBy(key, "list").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(F.col("n") <= 26, F.substring(F.lit(LETTERS), F.col("n"), F.lit(1))).otherwise(F.col("n").cast("string"))
    return r.select(key, "line_no", F.when(F.col("item"), F.concat(F.lit("[^"), mark, F.lit("]: "), F.regexp_replace("line", r"^\s*\d+[.、．]\s*", ""))).otherwise(F.col("line")).alias("line"))


def mark_titles(lines: DataFrame, contents: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Lines that are a title of the contents (key, name, level) with their marks, and the contents that no line matches."""
    c = contents.select(key, X.clean_title(F.col("name")).alias("clean"), "level", "name").dropDuplicates([key, "clean"])
    l = lines.withColumn("clean", X.clean_title(F.regexp_replace("line", "^#+ *", "")))
    marked = l.join(c, [key, "clean"], "left").select(key, "line_no", F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), "level"), F.lit(" "), F.regexp_replace("line", "^#+ *", ""))).otherwise(F.col("line")).alias("line"))
    return marked, c.join(l.select(key, "clean").distinct(), [key, "clean"], "left_anti").select(key, "name", "level")


#: Letters of romanized readings in brackets, in which no letter is a footnote mark.
READING = re.compile(r"[（(][a-zA-Z'\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff]+[）)]")
NOTE_LINE = re.compile(r"\s*([a-zA-Z])\s+\S")
LONE_LETTER = re.compile(r"(?<![a-zA-Z])[a-zA-Z](?![a-zA-Z])")


def letter_notes(text: str) -> str:
    """Footnotes by letters in Markdown: lines that open with a lone letter are notes, and that letter alone in other lines refers to one.

    Letters inside a bracketed reading refer to nothing, nor do letters that no note has.
    """
    lines = text.split("\n")
    notes = {k: m[1] for k, line in enumerate(lines) if (m := NOTE_LINE.match(line))}
    known = set(notes.values())

    def referred(line: str) -> str:
        shut = [m.span() for m in READING.finditer(line)]
        mark = lambda m: f"[^{m[0]}]" if m[0] in known and not any(a <= m.start() < b for a, b in shut) else m[0]
        return LONE_LETTER.sub(mark, line)

    return "\n".join(f"[^{notes[k]}]:{line[line.index(notes[k]) + 1 :]}" if k in notes else referred(line) for k, line in enumerate(lines))


@arrow_udf(T.StringType())
def lettered_notes(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else letter_notes(x) for x in c.to_pylist()], pa.string())
