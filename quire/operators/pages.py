"""Places of a text on printed pages: a stream of characters with their boxes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity
from . import filters

ANCHOR = 6
BREAKS = re.compile(r"[^\w]|[0-9０-９_]")


def index(chars: DataFrame) -> DataFrame:
    """``doc_id, char_pos, page, line_id, ch, x0, y0, x1, y1``: characters (with page, seq) that are no blanks, numbered through the document."""
    c = chars.where(F.trim("ch") != "")
    per_page = c.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    start = per_page.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")) - 1
    return c.withColumn("local", local).join(start, ["doc_id", "page"]).select("doc_id", (F.col("start") + F.col("local")).alias("char_pos"), "page", "line_id", "ch", "x0", "y0", "x1", "y1")


def streams(idx: DataFrame) -> DataFrame:
    """``doc_id, text`` of each document's characters in order."""
    g = idx.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_pos", "ch"))).alias("cs"))
    return g.select("doc_id", F.array_join(F.transform("cs", lambda x: x["ch"]), "").alias("text"))


def occurrences(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle_id, doc_id, start_pos, end_pos`` of every place of a needle (needle_id, doc_id, needle), overlapping ones too."""
    n = needles.select("needle_id", "doc_id", F.regexp_replace("needle", r"\s+", "").alias("needle")).where("needle <> ''")
    j = n.join(texts, "doc_id").where(F.instr("text", F.col("needle")) > 0)
    at = F.filter(F.sequence(F.lit(0), F.length("text") - F.length("needle")), lambda i: F.substring("text", i + 1, F.length("needle")) == F.col("needle"))
    return j.select("needle_id", "doc_id", F.explode(at).alias("start_pos"), F.length("needle").alias("n")).select("needle_id", "doc_id", "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"))


def located(found: DataFrame, idx: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``needle_id, status, start_pos, end_pos, pages``: exact if there is one place on the hinted page or at all, crosspage, or ambiguous."""
    ends = found.join(idx.select("doc_id", F.col("char_pos").alias("start_pos"), F.col("page").alias("first_page")), ["doc_id", "start_pos"])
    ends = ends.join(idx.select("doc_id", (F.col("char_pos") + 1).alias("end_pos"), F.col("page").alias("last_page")), ["doc_id", "end_pos"])
    if hints is not None:
        ends = ends.join(hints.select("needle_id", "page_hint"), "needle_id", "left").where("page_hint is null or page_hint between first_page and last_page")
    g = ends.groupBy("needle_id", "doc_id").agg(F.count("*").alias("n"), F.min("start_pos").alias("start_pos"), F.min("end_pos").alias("end_pos"), F.array_sort(F.collect_set("first_page")).alias("pages"), F.max(F.col("last_page") > F.col("first_page")).alias("crosses"))
    return g.select("needle_id", "doc_id", F.when(F.col("n") > 1, "ambiguous").when(F.col("crosses"), "crosspage").otherwise("exact").alias("status"), "start_pos", "end_pos", "pages")


def quads(spans: DataFrame, idx: DataFrame) -> DataFrame:
    """``needle_id, page, line_id, x0, y0, x1, y1``: the box of each line of a span (needle_id, doc_id, start_pos, end_pos).

    A span is short, so it is laid out as its characters and met by an equal join, and not by a range.
    """
    each = spans.select("needle_id", "doc_id", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("char_pos"))
    return each.join(idx, ["doc_id", "char_pos"]).groupBy("needle_id", "page", "line_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def fragments(c, least: int = ANCHOR):
    """Column: the stretches of a text between marks, blanks and digits of ``least`` characters or more, longest first."""
    parts = F.filter(F.split(c, r"[\p{P}\p{S}\p{Z}\p{Nd}\s]+"), lambda x: F.length(x) >= least)
    return F.transform(F.array_sort(F.transform(parts, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


CUTOFF, ENDS, TIE = 85.0, 80.0, 0.5  # least ratio of a place, of its first and last END characters, and by how much another must be worse
END, LEAST = 4, 4
PLACES = "needle_id {kind}, doc_id {doc}, start_pos int, end_pos int, score double, tied boolean"


def similar_place(text: str, needle: str, low: int, high: int) -> tuple[int, int, float] | None:
    """The window of the needle's length in ``text[low:high]`` most like it, if it reaches CUTOFF and both its ends reach ENDS."""
    n = len(needle)
    if n < LEAST or high - low < n or (m := similarity.windows_of_length(text[low:high], needle)) is None or m[2] < CUTOFF:
        return None
    found, at, score = m
    for a, b in ((needle[:END], found[:END]), (needle[-END:], found[-END:])):
        if similarity.partial_ratio(a, b)[0] < ENDS:
            return None
    return low + at, low + at + n, score


def fuzzy(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle_id, doc_id, start_pos, end_pos, score, tied``: the most similar place of each needle (needle_id, doc_id, needle, low, high) within ``low..high``.

    ``low`` and ``high`` are null for the whole text. The stretches left and right of the place are searched again: another one within TIE makes it tied. Needles under
    LEAST characters and those without a place are left out.
    """
    given = needles.select("needle_id", "doc_id", F.regexp_replace("needle", r"\s+", "").alias("needle"), "low", "high").join(texts, "doc_id")

    def run(batches):
        for batch in batches:
            at, out = [], []
            for k, (needle, low, high, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                low, high = low or 0, len(text) if high is None else min(high, len(text))
                if best := similar_place(text, needle or "", low, high):
                    others = (similar_place(text, needle, low, best[0]), similar_place(text, needle, best[1], high))
                    at.append(k)
                    out.append((*best, any(o and o[2] >= best[2] - TIE for o in others)))
            take, cols = pa.array(at, pa.int64()), list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.bool_())))], ["needle_id", "doc_id", "start_pos", "end_pos", "score", "tied"])

    rows = given.select("needle_id", "doc_id", "needle", F.col("low").cast("int"), F.col("high").cast("int"), "text")
    return rows.mapInArrow(run, PLACES.format(kind=rows.schema["needle_id"].dataType.simpleString(), doc=rows.schema["doc_id"].dataType.simpleString()))


def cascade(needles: DataFrame, idx: DataFrame, allow_fragment: bool = False, allow_fuzzy: bool = False) -> DataFrame:
    """``needle_id, doc_id, method, status, start_pos, end_pos, score``: exact places, then those of fragments, longest first, then similar ones.

    ``needles``: (needle_id, doc_id, needle, page_hint); a null hint is the whole document. Status: ``hit``, ``preview`` (by a fragment or by
    similarity, unless allowed), ``ambiguous``, ``skip`` (too short, too long, or without a place). Each stage gets what the ones before left.
    """
    guarded = filters.fragment_guard(needles, "needle")
    sound, texts = guarded.where("rejected is null").drop("rejected"), streams(idx)
    size = F.length(F.regexp_replace("needle", r"\s+", ""))
    hints = sound.where("page_hint is not null").select("needle_id", "page_hint")

    def placed(rows: DataFrame, method: str, score) -> DataFrame:
        status = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.lit(method == "fragment" and not allow_fragment), "preview").otherwise("hit")
        return rows.select("needle_id", "doc_id", F.lit(method).alias("method"), status.alias("status"), "start_pos", "end_pos", score.alias("score"))

    one = located(occurrences(texts, sound), idx, hints)
    exact = placed(one, "exact", F.lit(100.0))
    left = sound.join(exact.select("needle_id", "doc_id"), ["needle_id", "doc_id"], "left_anti")
    parts = left.select("needle_id", "doc_id", size.alias("size"), "page_hint", F.posexplode(fragments(F.col("needle"))).alias("nth", "needle"))
    named = parts.withColumn("needle_id", F.struct("needle_id", "nth", "size"))
    some = located(occurrences(texts, named), idx, named.where("page_hint is not null").select("needle_id", "page_hint"))
    first = some.groupBy(F.col("needle_id.needle_id").alias("needle_id"), "doc_id").agg(F.min_by(F.struct("status", "start_pos", "end_pos", F.col("needle_id.size").alias("size")), "needle_id.nth").alias("b")).select("needle_id", "doc_id", "b.*")
    fragment = placed(first, "fragment", F.round(F.lit(100.0) * (F.col("end_pos") - F.col("start_pos")) / F.col("size"), 1))
    left = left.join(fragment.select("needle_id", "doc_id"), ["needle_id", "doc_id"], "left_anti")
    pages = idx.groupBy("doc_id", F.col("page").alias("page_hint")).agg(F.min("char_pos").alias("low"), (F.max("char_pos") + 1).alias("high"))
    whole = left.where("page_hint is null").select("needle_id", "doc_id", "needle", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    like = fuzzy(texts, whole.unionByName(left.join(pages, ["doc_id", "page_hint"]).select("needle_id", "doc_id", "needle", F.col("low").cast("int"), F.col("high").cast("int"))))
    similar = like.select("needle_id", "doc_id", F.lit("fuzzy").alias("method"), F.when(F.col("tied"), "ambiguous").when(F.lit(allow_fuzzy), "hit").otherwise("preview").alias("status"), "start_pos", "end_pos", "score")
    found = exact.unionByName(fragment).unionByName(similar)
    none = guarded.join(found.select("needle_id", "doc_id"), ["needle_id", "doc_id"], "left_anti")
    return found.unionByName(none.select("needle_id", "doc_id", F.lit("none").alias("method"), F.lit("skip").alias("status"), *(F.lit(-1).alias(c) for c in ("start_pos", "end_pos")), F.lit(0.0).alias("score")))
