"""Segmentation: lines, sections, cuts, merges, sentences and their contexts, with character offsets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Marks at which a piece may be split hard.
HARD_STOPS = frozenset("。！？；!?;…")


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line_start, line``: 1-based lines at line feeds, 0-based character offsets; null texts have none.

    A text is cut within its row, so that neither lines nor offsets need a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, numbers, starts, lines = [], [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                if body is None:
                    continue
                start = 0
                for n, line in enumerate(body.split("\n"), 1):
                    at.append(k)
                    numbers.append(n)
                    starts.append(start)
                    lines.append(line)
                    start += len(line) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(lines, pa.string())], [key, "line_no", "line_start", "line"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, line_no int, line_start int, line string")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = (2,)) -> DataFrame:
    """Sections that start at each line of ``#`` marks of one of the levels; text before the first is its own.

    ``key, section_idx, title, level, body``; without a title line the title is null and the level 0. The text is split
    before its title lines, within its row, so nothing is shuffled and no group can be too large.
    """
    head = "(?:" + "|".join("#" * n for n in levels) + ") "
    parts = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), f"\n(?={head})")).alias("section_idx", "body"))
    line = F.substring_index("body", "\n", 1)
    titled = line.rlike(f"^{head}")
    return parts.select(key, "section_idx", F.when(titled, F.regexp_replace(line, "^#+ ", "")).alias("title"), F.when(titled, F.length(F.regexp_extract(line, "^(#+) ", 1))).otherwise(0).alias("level"), "body")


def merge_short(rows: DataFrame, key: str, order: str, text: str, least: int = 100) -> DataFrame:
    """Glues rows shorter than ``least`` onto the next long one: ``key, group_idx, merged``.

    A group ends with its long row; short rows at the end are a group of their own.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    g = F.coalesce(F.sum((F.length(text) >= least).cast("int")).over(w), F.lit(0))
    marked = rows.select(key, order, text, g.alias("group_idx"))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(key, "group_idx").agg(F.array_join(F.transform(pieces, lambda x: x["t"]), "\n").alias("merged"))


def cut(text: str, size: int = 600) -> list[str]:
    """Pieces of about ``size`` characters, cut at blank lines; the line ends between lines don't count.

    A piece closes with a blank line once it is full. At one and a half times the size it is split hard: at the
    nearest stop before that length, else at ``size``; what remains then counts with its line ends. Every kind of line
    end becomes a line feed. Joined, and line ends aside, the pieces are the text.
    """
    size = max(50, size)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for line in text.splitlines():
        held.append(line)
        length += len(line)
        if line.strip():
            if 2 * length >= 3 * size:
                head, rest = hard_split("\n".join(held), size)
                out.append(head)
                held, length = ([rest] if rest else []), len(rest)
        elif length >= size:
            out.append("\n".join(held))
            held, length = [], 0
    rest = "\n".join(held)
    while 2 * len(rest) > 3 * size:
        head, rest = hard_split(rest, size)
        out.append(head)
    return [*out, rest] if rest or held else out


def hard_split(text: str, size: int) -> tuple[str, str]:
    """The last stop between half and one and a half times the size, else the size itself."""
    for p in range(min(len(text), size * 3 // 2), size // 2 - 1, -1):
        if text[p - 1] in HARD_STOPS:
            return text[:p], text[p:]
    return text[:size], text[size:]


SENTENCE_END = re.compile(r"[。！？…]+[”’）\]】」』]*|[.!?]+[”’\"'）\]】」』]*|\n(?:\s*\n)+")


def split_simple(text: str) -> list[str]:
    """Sentences with their end marks and the line ends after them; joined they give the text again.

    A period after a digit ends none unless it is the last character.
    """
    out, start = [], 0
    for m in SENTENCE_END.finditer(text):
        at, end = m.span()
        if at < start:
            continue
        if text[at] == "." and at and text[at - 1].isdigit() and end < len(text):
            continue
        while end < len(text) and text[end] in "\r\n":
            end += 1
        out.append(text[start:end])
        start = end
    if start < len(text):
        out.append(text[start:])
    return out


TITLE = re.compile(r"^#{1,6}\s+\S")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\S")


def split_markdown(text: str) -> list[str]:
    """Sentences of Markdown: a title or list item with its blank lines is one; the rest is split simply."""
    if not text.strip():
        return []
    out: list[str] = []
    run: list[str] = []
    held = text.splitlines(keepends=True)
    k = 0
    while k < len(held):
        if TITLE.match(held[k]) or ITEM.match(held[k]):
            if run:
                out += split_simple("".join(run))
                run = []
            j = k + 1
            while j < len(held) and not held[j].strip():
                j += 1
            out.append("".join(held[k:j]))
            k = j
        else:
            run.append(held[k])
            k += 1
    return out + split_simple("".join(run)) if run else out


def _explode(docs: DataFrame, key: str, text: str, parts, columns: str) -> DataFrame:
    """``mapInArrow`` from one text to numbered parts with offsets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, number, start, values, first, last = [], [], [], [], [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, line = 0, 1
                for j, part in enumerate(parts(body or "")):
                    lead = len(part) - len(part.lstrip())
                    begin = line + part[:lead].count("\n")
                    keys.append(k)
                    number.append(j)
                    start.append(at)
                    values.append(part)
                    first.append(begin)
                    last.append(max(begin, line + part.rstrip().count("\n")))
                    at, line = at + len(part), line + part.count("\n")
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(x, pa.int32()) for x in (number, start)), pa.array(values, pa.string()), *(pa.array(x, pa.int32()) for x in (first, last))], ["key", "n", "s", "part", "f", "l"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n int, s int, part string, f int, l int").toDF(key, *columns.split())


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", markdown: bool = True) -> DataFrame:
    """``key, sent_idx, start_pos, sentence, start_line, end_line``; sentences of a text join to the text.

    Null and blank texts have none. Lines are 1-based; the first is that of the first character that is no blank.
    """
    return _explode(docs, key, text, split_markdown if markdown else split_simple, "sent_idx start_pos sentence start_line end_line")


def cuts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 600, threshold: int = 0) -> DataFrame:
    """``key, chunk_idx, target`` of the texts cut by ``size``; texts of at most ``threshold`` characters stay whole."""
    whole = lambda x: [x] if len(x) <= threshold else cut(x, size)
    return _explode(docs, key, text, whole, "chunk_idx start_pos target start_line end_line").drop("start_pos", "start_line", "end_line")


def context(paragraph: str, start: int, end: int, pad: int = 800, most: int = 3000) -> str:
    """The paragraph around its stretch ``[start, end)``, headed by its title line if that is cut off."""
    before, after = paragraph[max(0, start - pad) : start].rstrip(), paragraph[end : end + pad].lstrip()
    body = "\n".join(x for x in (before, paragraph[start:end], after) if x)
    title = paragraph.split("\n", 1)[0]
    return (title + "\n" + body if title.startswith("#") and title not in body else body)[:most]


def chunks_with_context(docs: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = (1, 2), size: int = 600, pad: int = 800, most: int = 3000) -> DataFrame:
    """Sections, cut by length, each piece with its context: ``key, section_idx, chunk_idx, target, context``.

    The context is that of the piece's own place, also where its text occurs before.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, sections_, numbers, targets, around = [], [], [], [], []
            for k, (section, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                place, body = 0, "\n".join(body.splitlines())
                for n, piece in enumerate(x for x in cut(body, size) if x.strip()):
                    place = max(0, body.find(piece, place))
                    at.append(k)
                    sections_.append(section)
                    numbers.append(n)
                    targets.append(piece)
                    around.append(context(body, place, place + len(piece), pad, most))
                    place += len(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (sections_, numbers)), *(pa.array(x, pa.string()) for x in (targets, around))], [key, "section_idx", "chunk_idx", "target", "context"])

    s = sections(docs, key, text, levels).select(key, "section_idx", "body")
    return s.mapInArrow(run, f"{key} {kind}, section_idx int, chunk_idx int, target string, context string")


def merged_cuts(docs: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = (2,), threshold: int = 1000, size: int = 800, least: int = 120) -> DataFrame:
    """``key, piece_idx, target``: sections, cut where they are longer than ``threshold``, short pieces glued onto the next long one.

    Blank pieces are left out. Null texts have none. The pieces of a document are numbered in order.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, sections_, numbers, targets = [], [], [], []
            for k, (section, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, piece in enumerate([body] if len(body) <= threshold else cut(body, size)):
                    at.append(k)
                    sections_.append(section)
                    numbers.append(n)
                    targets.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (sections_, numbers)), pa.array(targets, pa.string())], [key, "section_idx", "n", "piece"])

    s = sections(docs, key, text, levels).select(key, "section_idx", "body")
    pieces = s.mapInArrow(run, f"{key} {kind}, section_idx int, n int, piece string").withColumn("at", F.struct("section_idx", "n"))
    glued = merge_short(pieces, key, "at", "piece", least).where(F.length(T.squeeze(F.col("merged"))) > 0)
    order = Window.partitionBy(key).orderBy("group_idx")  # the pieces of one document
    return glued.select(key, (F.row_number().over(order) - 1).alias("piece_idx"), F.col("merged").alias("target"))


def table_of_contents(docs: DataFrame, key: str = "doc_id", text: str = "text", indent: int = 4, base: int = 1) -> DataFrame:
    """Bullet lines as ``key, line_no, name, level``: the level grows with the indent."""
    l = to_lines(docs, key, text)
    hit = l.where(F.col("line").rlike(r"^\s*[-*+]\s+\S"))
    return hit.select(key, "line_no", F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+", "")).alias("name"), (F.floor(F.length(F.regexp_extract("line", r"^(\s*)", 1)) / indent) + base).cast("int").alias("level"))
