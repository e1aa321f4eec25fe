"""Queries on characters, words and dictionary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, lexicon
from .registry import Catalogue, spread, table

catalogue = Catalogue()

#: A small table of forms and of words; a full standard comes as a table.
FORMS = [("図", "variant", "图"), ("書", "traditional", "书"), ("橋", "traditional", "桥"), ("車", "traditional", "车"), ("員", "traditional", "员"), ("製", "traditional", "制"), ("帳", "traditional", "帐"), ("帳", "variant", "账"), ("係", "traditional", "系"), ("駅", "variant", "驿"), ("写", "traditional", "写"), ("庫", "traditional", "库"), ("録", "variant", "录"), ("師", "traditional", "师")]
NOTES = [("係", "系、係分用"), ("帳", "账、帐分用")]
WORDS = [("较对", "校对"), ("校对", "校对"), ("不足为凭", "不足为凭"), ("足为凭", "足为凭"), ("为凭", "为凭"), ("信扎", "信札"), ("印刷", "印刷"), ("令人费解", "令人费解"), ("人费", "人费"), ("竹简", "竹简"), ("渐渐", "渐渐"), ("的的", "的"), ("甚是难得", "甚是难得")]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_FORMS = f"(SELECT * FROM (VALUES {_values(FORMS)}) v(ch, kind, standard_ch))"
_NOTES = f"(SELECT * FROM (VALUES {_values(NOTES)}) v(ch, note))"
_WORDS = f"(SELECT * FROM (VALUES {_values(WORDS)}) v(word, standard))"
_STANDARD = "(SELECT DISTINCT unnest(string_split(corrected_sentence, '')) AS ch FROM max_pipeline)"
_CHARACTERS = "(SELECT doc_id, pos, ch FROM (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS ch FROM documents) WHERE regexp_matches(ch, '^[\\x{4e00}-\\x{9fff}]$'))"
_FOUND = f"""WITH c AS MATERIALIZED {_CHARACTERS},
    m AS (SELECT ch, kind, string_agg(DISTINCT standard_ch, '' ORDER BY standard_ch) AS s FROM {_FORMS} GROUP BY ch, kind HAVING string_agg(DISTINCT standard_ch, '' ORDER BY standard_ch) <> ch),
    v AS (SELECT m.ch, kind, s || CASE WHEN note IS NULL THEN '' ELSE '(' || note || ')' END AS suggestion FROM m LEFT JOIN {_NOTES} n USING (ch)),
    d AS MATERIALIZED (SELECT DISTINCT ch FROM c),
    o AS (SELECT d.ch, 'not_in_standard' AS kind, '' AS suggestion FROM d LEFT JOIN (SELECT DISTINCT ch FROM v) x USING (ch) LEFT JOIN (SELECT DISTINCT ch FROM {_STANDARD}) y USING (ch) WHERE x.ch IS NULL AND y.ch IS NULL),
    f AS (SELECT doc_id, pos::INT AS pos, ch, kind, suggestion FROM c JOIN (SELECT * FROM v UNION ALL SELECT * FROM o) USING (ch))"""


def _characters(spark, sf):
    standard = table(spark, sf, "max_pipeline", "corrected_sentence").select(F.explode(F.split("corrected_sentence", "")).alias("ch"))
    return lexicon.character_findings(spread(table(spark, sf, "documents", "doc_id", "text")), spark.createDataFrame(FORMS, "ch string, kind string, standard_ch string"), standard, spark.createDataFrame(NOTES, "ch string, note string"))


def _words(spark, sf):
    return lexicon.word_findings(spread(table(spark, sf, "documents", "doc_id", "text")), spark.createDataFrame(WORDS, "word string, standard string"))


@catalogue.query(_FOUND + " SELECT * FROM f")
def char_standard_findings(spark, sf):
    return _characters(spark, sf)


@catalogue.query(_FOUND + " SELECT kind, CASE WHEN kind = 'not_in_standard' THEN 'info' ELSE 'error' END AS severity, count(*) AS findings, count(DISTINCT ch) AS characters, count(DISTINCT doc_id) AS documents FROM f GROUP BY ALL")
def char_findings_by_type(spark, sf):
    f = _characters(spark, sf)
    return f.groupBy("kind", lexicon.severity(F.col("kind")).alias("severity")).agg(F.count("*").alias("findings"), F.countDistinct("ch").alias("characters"), F.countDistinct("doc_id").alias("documents"))


_OCCURRENCES = f"""SELECT doc_id, start_pos, (start_pos + length(word))::INT AS end_pos, word, standard AS suggestion FROM (
    SELECT doc_id, (i - 1)::INT AS start_pos, word, standard FROM (
        SELECT doc_id, text, word, standard, unnest(range(1, length(text) - length(word) + 2)) AS i FROM documents, {_WORDS} WHERE contains(text, word))
    WHERE substr(text, i, length(word)) = word)"""


@catalogue.query(_OCCURRENCES)
def variant_word_occurrences(spark, sf):
    return _words(spark, sf)


@catalogue.query(f"SELECT doc_id, word, standard AS suggestion, (instr(text, word) - 1)::INT AS start_pos FROM documents, {_WORDS} WHERE instr(text, word) > 0")
def lexicon_first_occurrence(spark, sf):
    return lexicon.first_occurrences(_words(spark, sf))


@catalogue.query(f"""
    WITH s AS ({_OCCURRENCES}), a AS (SELECT *, max(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
    r AS (SELECT *, sum(CASE WHEN far IS NULL OR start_pos >= far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, word) AS run FROM a)
    SELECT doc_id, start_pos, end_pos, word, suggestion, run::INT AS run, row_number() OVER (PARTITION BY doc_id, run ORDER BY end_pos - start_pos DESC, start_pos, word) = 1 AS kept FROM r""")
def overlap_resolution(spark, sf):
    return lexicon.resolve_overlaps(_words(spark, sf))


@catalogue.query("""
    WITH p AS (SELECT DISTINCT chunk_idx::VARCHAR AS k, kind AS v, min(chunk_id) OVER (PARTITION BY chunk_idx, kind) AS first FROM your_markdown)
    SELECT k, string_agg(v, '；' ORDER BY first) AS merged FROM p GROUP BY k""")
def conflict_merge_map(spark, sf):
    """A map of many values for one key: first seen first, each once, joined."""
    t = table(spark, sf, "your_markdown", "chunk_id", "chunk_idx", "kind").select(F.col("chunk_idx").cast("string").alias("k"), F.col("kind").alias("v"), F.col("chunk_id").alias("seen"))
    return dictionary.merge_map(t)


@catalogue.query("""
    SELECT book_id, coalesce(pen_name, last_value(pen_name IGNORE NULLS) OVER (ORDER BY book_id, loaded_at, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pen_name, loaded_at FROM manuscripts""")
def filled_pen_names(spark, sf):
    """Missing pen names filled down from the row before, as blank cells of a printed table are read."""
    return dictionary.fill_down(table(spark, sf, "manuscripts", "book_id", "pen_name", "loaded_at", "file_name"), ["book_id", "loaded_at", "file_name"], "pen_name").select("book_id", "pen_name", "loaded_at")


@catalogue.query("""
    SELECT book_id, title, lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) AS extension, lower(split_part(coalesce(lang, ''), '-', 1)) AS lang
    FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loaded_at DESC, file_name DESC, title DESC) AS rn FROM manuscripts) WHERE rn = 1""")
def latest_manuscripts(spark, sf):
    """The last registration of each book: later wins."""
    t = table(spark, sf, "manuscripts", "book_id", "title", "lang", "file_name", "loaded_at")
    last = dictionary.last_wins(t, ["book_id"], ["loaded_at", "file_name", "title"])
    return last.select("book_id", "title", F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.lower(F.split_part(F.coalesce("lang", F.lit("")), F.lit("-"), F.lit(1))).alias("lang"))
