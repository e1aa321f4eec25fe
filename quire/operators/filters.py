"""Filters and labels on findings: what can be acted on, what is looked for, what is left out and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that a check of characters passes over.
PASSED = r"^[A-Za-z0-9\s，。、；：？！“”‘’（）《》〈〉【】…—·,.;:?!\"'()\[\]<>-]$"
#: Classes of findings that somebody has to act on.
CLASSES = ("must_fix", "polish", "verify")
SHORTEST, LONGEST = 2, 200  # characters of a fragment that is searched for on pages


def not_ignored(findings: DataFrame, ignored: DataFrame | None = None, column: str = "ch") -> DataFrame:
    """Findings whose character is neither plain nor in the list (ch) of ignored ones; a null character is left out."""
    kept = findings.where(~F.col(column).rlike(PASSED))
    return kept if ignored is None else kept.join(ignored.select(F.col("ch").alias(column)).distinct(), column, "left_anti").select(*findings.columns)


def actionable(findings: DataFrame) -> DataFrame:
    """Findings of one of CLASSES, in any case, with a place and a text (fix_class, location, original)."""
    filled = lambda c: F.length(T.squeeze(F.coalesce(F.col(c), F.lit("")))) > 0
    return findings.where(F.lower("fix_class").isin(*CLASSES) & filled("location") & filled("original"))


def fragment_guard(fragments: DataFrame, column: str = "fragment") -> DataFrame:
    """All rows with ``rejected``: ``too_short``, ``too_long``, or null for a fragment that can be searched for. A null is too short."""
    size = F.length(F.coalesce(F.col(column), F.lit("")))
    return fragments.withColumn("rejected", F.when(size < SHORTEST, "too_short").when(size > LONGEST, "too_long"))


def annotated(c: Column) -> Column:
    """Whether a definition holds a tag besides those of links."""
    return F.regexp_replace(c, r"(?i)</?a(?:\s[^<>]*)?>", "").rlike("<[^<>]+>")


def selected(rows: DataFrame, done: DataFrame | None, first: int | None = None, last: int | None = None, numbers: list[int] | None = None, column: str = "idx") -> DataFrame:
    """Rows of the 1-based inclusive range, or of the listed numbers, that are not among those done (idx)."""
    n = F.col(column)
    if numbers is not None:
        rows = rows.where(n.isin(numbers))
    else:
        rows = rows.where((n >= (first or 1)) & ((n <= last) if last is not None else F.lit(True)))
    return rows if done is None else rows.join(done.select(column).distinct(), column, "left_anti").select(*rows.columns)


def style_class(fix_class: Column, phase: Column) -> Column:
    """The class by which a finding is marked: its own, else one by its phase, else ``verify``."""
    own = F.lower(fix_class)
    by_phase = F.when(phase.contains("structure"), "polish").when(phase.contains("llm") | phase.contains("variant"), "must_fix")
    return F.when(own.isin(*CLASSES), own).otherwise(F.coalesce(by_phase, F.lit("verify")))


def labels(phase: Column, kind: Column, severity: Column) -> Column:
    """Distinct sorted labels of a finding, joined."""
    said = F.array(
        F.when(phase.contains("structure") | kind.contains("continuity") | kind.contains("hierarchy"), "结构"),
        F.when(phase.contains("char") | kind.isin("traditional", "variant", "not_in_standard"), "字形"),
        F.when(phase.contains("word") | kind.contains("word"), "词语"),
        F.when(phase.contains("llm"), "语句"),
        F.when(severity == "error", "必改"),
    )
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(said))), "、")


def focus_pair(a: Column, b: Column, size: int = 20) -> Column:
    """``"a"→"b"``, each cut to ``size`` characters; a null is empty."""
    clip = lambda c: F.concat(F.lit('"'), F.left(F.coalesce(c, F.lit("")), F.lit(size)), F.lit('"'))
    return F.concat(clip(a), F.lit("→"), clip(b))


def note_of(suggestion: Column) -> tuple[Column, Column]:
    """``字(注)`` apart: the form and the note; without a note the whole and null."""
    shape = r"^(\S+)\((.+)\)$"
    note = F.nullif(F.regexp_extract(suggestion, shape, 2), F.lit(""))
    return F.when(note.isNotNull(), F.regexp_extract(suggestion, shape, 1)).otherwise(suggestion), note


def paragraph_number(location: Column) -> Column:
    """The number of a place ``P12``; null for any other."""
    return F.regexp_extract(location, r"P(\d{1,9})", 1).try_cast("int")


def page_hint(hint: Column, pages: Column) -> tuple[Column, Column]:
    """``(page, reason)`` of a hint: a whole number from 1 to ``pages``, or null and why: ``missing``, ``unreadable``, ``out_of_range``."""
    n = F.when(F.trim(hint).rlike(r"^\d{1,9}$"), F.trim(hint)).cast("int")
    good = n.between(F.lit(1), pages)
    reason = F.when(F.coalesce(F.trim(hint), F.lit("")) == "", "missing").when(n.isNull(), "unreadable").when(~good, "out_of_range")
    return F.when(good, n), reason


def single_form_kind(segment: Column) -> Column:
    """The kind of one form in a dictionary's head: ``other_variant``, ``standard_variant`` or ``traditional``."""
    raised = F.regexp_extract(segment, r"(?is)<sup[^>]*>(.*?)</sup>", 1)
    return F.when(segment.contains("⁑"), "other_variant").when(raised.contains("*") | raised.contains("⁎"), "standard_variant").otherwise("traditional")


def by_key_length(pairs: DataFrame, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is one character, and those of longer keys."""
    return pairs.where(F.length(key) == 1), pairs.where(F.length(key) > 1)


def edit_reason(text: Column, original: Column, corrected: Column, ratio: Column, least: float = 60.0) -> Column:
    """Why an edit is not applied: ``no_op_change``, ``match_no_location``, ``match_below_threshold``; null if it is. ``ratio`` is null without a place."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(original) | empty(corrected) | (original == corrected), "no_op_change").when(text.isNull() | ratio.isNull(), "match_no_location").when(ratio < least, "match_below_threshold")
