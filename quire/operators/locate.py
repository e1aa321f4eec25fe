"""Locating edits in their source: exact in the named place, exact in the whole book, then by similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rolling, similarity
from ..functions import text as T

ACCEPT, LEAD = 60.0, 5.0
SALTS = 8  # parts of a phrase that many chunks of one book repeat


def key_text(c):
    """Column: the text to look for, without heading and list marks."""
    return F.regexp_replace(F.trim(c), r"^(?:#{1,6}\s+|[-*+]\s+)", "")


def in_named_chunk(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """``finding_id, book_id, chunk_id, key, outcome, position, occurrences`` by exact search in the chunk a finding names.

    Outcomes: ``empty_key_text``, ``p_out_of_range`` (no such chunk, or it has no text), ``located``,
    ``not_in_chunk``. The position is that of the first occurrence, 0-based, and -1 where there is none.
    """
    f = findings.select("finding_id", "book_id", "chunk_id", key_text(F.col("original_sentence")).alias("key"))
    c = chunks.select(F.col("chunk_id"), F.col("target"))
    j = f.join(c, "chunk_id", "left")
    blank = F.length(T.squeeze(F.coalesce("key", F.lit("")))) == 0
    at = F.instr("target", F.col("key")) - 1
    outcome = F.when(blank, "empty_key_text").when(F.col("target").isNull(), "p_out_of_range").when(at >= 0, "located").otherwise("not_in_chunk")
    many = F.when(outcome == "located", (F.length("target") - F.length(F.replace("target", F.col("key"), F.lit("")))) / F.length("key")).otherwise(0)
    return j.select("finding_id", "book_id", "chunk_id", "key", outcome.alias("outcome"), F.when(outcome == "located", at).otherwise(-1).alias("position"), many.cast("int").alias("occurrences"))


def in_book(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """``finding_id, chunks, chunk_id``: how many chunks of its book contain a key, and the first of them.

    ``keys``: (finding_id, book_id, key); blank keys and null books are in none. A contains join by the longest run of a
    power of two of characters that each key begins with. The hashes of those runs, each with its book, make a bitmap of
    fixed size; one scan of the chunks gives the places it lets through, with as many characters as such a key can have,
    and those meet the keys on the hash, where book and whole key are compared. Nothing else of the chunks is laid out or
    shuffled. Both sides are salted, so that a phrase that one book repeats is split.
    """
    distinct = keys.where(F.col("book_id").isNotNull() & (F.length("key") > 0)).select(F.col("book_id").cast("long").alias("book_id"), "key").distinct()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h = [], []
            for book, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.append(1 << len(key).bit_length() - 1)
                h.append(_of_book(rolling.runs(rolling.codes([key[: n[-1]]])[0], n[-1:])[n[-1]], book)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], ["book_id", "key", "n", "h"])

    k = distinct.mapInArrow(anchors, "book_id long, key string, n int, h long")
    sizes = sorted(r[0] for r in distinct.select(rolling.power(F.length("key"))).distinct().collect())  # powers of two
    shared = keys.sparkSession.sparkContext.broadcast((rolling.bitmap(k, "h"), sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            at, h_, seen = [], [], []
            for row, (book, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for n, h in rolling.runs(rolling.codes([text])[0], sizes).items():
                    h = _of_book(h, book)
                    for p in rolling.maybe(bits, h).tolist():
                        at.append(row)
                        h_.append(h[p])
                        seen.append(text[p : p + 2 * n])  # a key with this run has fewer than twice its characters
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(h_, np.uint64).view(np.int64)), pa.array(seen, pa.string())], ["book_id", "chunk_id", "h", "seen"])

    given = chunks.where("book_id is not null and target is not null").select(F.col("book_id").cast("long").alias("book_id"), "chunk_id", "target")
    places = given.mapInArrow(scan, f"book_id long, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, h long, seen string")
    places = places.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    salted = k.select("book_id", "key", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = places.join(salted, ["book_id", "h", "salt"]).where(F.startswith("seen", "key")).select("book_id", "key", "chunk_id").distinct()
    each = met.groupBy("book_id", "key").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("chunk_id"))
    return keys.withColumn("book_id", F.col("book_id").cast("long")).join(each, ["book_id", "key"]).select("finding_id", "chunks", "chunk_id")


def _of_book(h: np.ndarray, book: int) -> np.ndarray:
    """The same phrase of another book is another one."""
    with np.errstate(over="ignore"):
        return rolling.mixed(h ^ rolling.mixed(np.array([book], np.int64).view(np.uint64)))


def _apart(rows: DataFrame) -> DataFrame:
    """Joined rows in as many parts as there are cores or shuffle partitions: heavy work per row follows, so parts that are small in bytes must not be put together."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def by_similarity(residual: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best window of the named chunk for each key not found in it: ``finding_id, found, position, ratio, accepted``."""
    j = _apart(residual.join(chunks.select("chunk_id", "target"), "chunk_id").where("target is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a filter on an Arrow function's result would search twice
        for batch in batches:
            at, found = [], []
            for k, (text, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if key is not None and (m := similarity.best_match(text, key)):
                    at.append(k)
                    found.append((m[0], m[1], round(m[2], 6), m[2] >= ACCEPT))
            cols = list(zip(*found)) or [()] * 4
            types = (pa.string(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], ["finding_id", "found", "position", "ratio", "accepted"])

    rows = j.select("finding_id", "target", "key")
    return rows.mapInArrow(run, f"finding_id {rows.schema['finding_id'].dataType.simpleString()}, found string, position int, ratio double, accepted boolean")


def clear_winner(candidates: DataFrame, key: str = "finding_id") -> DataFrame:
    """The best of each key's candidates if it leads the next by LEAD or more; else ``fuzzy_tie`` with no candidate."""
    w = Window.partitionBy(key).orderBy(F.desc("ratio"), "chunk_id")
    r = candidates.withColumn("next", F.lead("ratio").over(w)).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    clear = F.col("next").isNull() | (F.col("ratio") - F.col("next") >= LEAD)
    return r.select(key, F.when(clear, F.col("chunk_id")).alias("chunk_id"), "ratio", F.when(clear, "located").otherwise("fuzzy_tie").alias("outcome"))


def apply_replacements(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, applied, dropped``: edits (key, start_pos, length, replacement) spliced from right to left.

    Of edits that overlap the later start wins and the other is dropped; edits beyond the text are dropped.
    """
    e = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "length", "replacement")), asc=False).alias("edits"))
    start = F.struct(F.col(text).alias("t"), F.length(text).alias("low"), F.lit(0).alias("n"))
    size = F.length(text)

    def step(acc, x):
        ok = (x["start_pos"] >= 0) & (x["start_pos"] + x["length"] <= F.least(acc["low"], size))
        now = F.concat(F.left(acc["t"], x["start_pos"]), x["replacement"], F.substring(acc["t"], x["start_pos"] + x["length"] + 1, F.length(acc["t"])))
        return F.struct(F.when(ok, now).otherwise(acc["t"]).alias("t"), F.when(ok, x["start_pos"]).otherwise(acc["low"]).alias("low"), (acc["n"] + F.when(ok, 1).otherwise(0)).alias("n"))

    done = docs.join(e, key, "left").withColumn("r", F.aggregate(F.coalesce("edits", F.array().cast("array<struct<start_pos:int,length:int,replacement:string>>")), start, step))
    return done.select(key, F.col("r.t").alias(text), F.col("r.n").alias("applied"), (F.coalesce(F.size("edits"), F.lit(0)) - F.col("r.n")).alias("dropped")).withColumn("dropped", F.greatest("dropped", F.lit(0)))


HEADING = re.compile(r"^(#{1,6})[ \t]+(?=\S)", re.M)
DEEPEST = 6


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_pos, level, title, end_pos, parent_pos``: Markdown headings, how far they reach, and what they stand under.

    A heading reaches to the next one whose level is at most one deeper than its own, or to the end; it stands under the last one
    before it of a lower level (-1 without one). Both are told by the last place of each level, so a text is linear in its headings.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                found = [(m.start(), len(m[1]), m.end()) for m in HEADING.finditer(body)]
                above, parents = [-1] * (DEEPEST + 1), []
                for start, level, _ in found:
                    parents.append(max(above[:level]))
                    above[level] = start
                below, ends = [len(body)] * (DEEPEST + 2), []
                for start, level, _ in reversed(found):
                    ends.append(min(below[: level + 2]))
                    below[level] = start
                at += [k] * len(found)
                line_end = lambda p: body.find("\n", p) if body.find("\n", p) >= 0 else len(body)  # noqa: E731, B023
                rows += [(start, level, body[after : line_end(after)], end, parent) for (start, level, after), end, parent in zip(found, reversed(ends), parents)]
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], [key, "start_pos", "level", "title", "end_pos", "parent_pos"])

    heads = docs.where(F.col(text).contains("#")).select(key, text)
    return heads.mapInArrow(run, f"{key} {kind}, start_pos int, level int, title string, end_pos int, parent_pos int")


def chapter_of(points: DataFrame, chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """``points`` with the title of the last chapter that starts at or before ``position``; null before the first.

    An as-of join: both sides are laid in one order per document and the last title is carried forward.
    """
    p = points.select(key, F.col("position").alias("at"), F.lit(1).alias("kind"), F.struct(*points.columns).alias("row"), F.lit(None).cast("string").alias("title"))
    c = chapters.select(key, F.col("start_pos").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(p.schema["row"].dataType).alias("row"), F.col("title"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(c).withColumn("chapter", F.last("title", ignorenulls=True).over(w)).where("kind = 1").select("row.*", "chapter")


def in_paragraph(edits: DataFrame, units: DataFrame, key: str = "path") -> DataFrame:
    """``edits`` with ``found``: whether the anchor stands in the paragraph of its number and nowhere else is looked.

    ``edits``: (key, pn, anchor); ``units``: (key, part, pos, text) where part is ``body`` or else ``header``, ``footer`` or ``textbox``, whose paragraphs
    are numbered on after those of the body, in this order. Anchors are compared as they are, then with dashes, quotes and blanks made alike.
    """
    order = F.create_map(*(F.lit(x) for p in (("body", 0), ("header", 1), ("footer", 2), ("textbox", 3)) for x in p))[F.col("part")]
    filled = units.where(F.length(T.squeeze(F.coalesce("text", F.lit("")))) > 0)
    numbered = filled.withColumn("pn", F.row_number().over(Window.partitionBy(key).orderBy(order, "pos")) - 1)  # the paragraphs of one document
    alike = lambda c: T.strip(F.regexp_replace(F.translate(T.fold_quotes(c), "–—―‒", "----"), f"{T.BLANKS}+", " "))
    held = F.contains("text", "anchor") | F.contains(alike(F.col("text")), alike(F.col("anchor")))
    return edits.join(numbered.select(key, "pn", "text"), [key, "pn"], "left").withColumn("found", F.coalesce(held & (F.col("anchor") != ""), F.lit(False))).drop("text")
