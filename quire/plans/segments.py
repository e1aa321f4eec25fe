"""Queries on segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment
from .registry import Catalogue, table

catalogue = Catalogue()

_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


@catalogue.query(f"SELECT doc_id, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS line_start, line FROM ({_LINES})")
def document_lines(spark, sf):
    return segment.to_lines(table(spark, sf, "documents", "doc_id", "text"))


@catalogue.query("""
    WITH l AS (SELECT chunk_id, generate_subscripts(string_split(target, chr(10)), 1) AS n, unnest(string_split(target, chr(10))) AS line FROM your_markdown),
    m AS (SELECT *, regexp_matches(line, '^(#|##|###) ') AS head FROM l),
    g AS (SELECT *, sum(head::INT) OVER (PARTITION BY chunk_id ORDER BY n) AS grp FROM m),
    d AS (SELECT *, dense_rank() OVER (PARTITION BY chunk_id ORDER BY grp) - 1 AS section_idx FROM g)
    SELECT chunk_id, section_idx::INT AS section_idx,
           max(CASE WHEN head THEN regexp_replace(line, '^#+ ', '') END) AS title,
           coalesce(max(CASE WHEN head THEN length(regexp_extract(line, '^(#+) ', 1)) END), 0)::INT AS level,
           string_agg(line, chr(10) ORDER BY n) AS body
    FROM d GROUP BY chunk_id, section_idx""")
def text_sections(spark, sf):
    return segment.sections(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target", (1, 2, 3))


@catalogue.query(f"""
    WITH g AS (SELECT *, coalesce(sum((length(line) >= 100)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_idx FROM ({_LINES}))
    SELECT doc_id, group_idx::BIGINT AS group_idx, string_agg(line, chr(10) ORDER BY line_no) AS merged FROM g GROUP BY ALL""")
def merged_short_lines(spark, sf):
    lines = segment.to_lines(table(spark, sf, "documents", "doc_id", "text"))
    return segment.merge_short(lines, "doc_id", "line_no", "line", 100)


@catalogue.query("""
    WITH l AS (SELECT chunk_id, generate_subscripts(string_split(target, chr(10)), 1) AS line_no, unnest(string_split(target, chr(10))) AS line FROM your_markdown)
    SELECT chunk_id, line_no::INT AS line_no, trim(regexp_replace(line, '^\\s*[-*+]\\s+', ''), ' ') AS name, (length(regexp_extract(line, '^(\\s*)', 1)) // 4 + 1)::INT AS level
    FROM l WHERE regexp_matches(line, '^\\s*[-*+]\\s+\\S')""")
def bullet_contents(spark, sf):
    return segment.table_of_contents(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target")


@catalogue.query("""
    WITH s AS (SELECT chunk_id, side, generate_subscripts(string_split(t, chr(10)), 1) AS n, unnest(string_split(t, chr(10))) AS line
               FROM (SELECT chunk_id, 'a' AS side, target AS t FROM your_markdown UNION ALL SELECT chunk_id, 'b', reference FROM your_markdown)),
    g AS (SELECT *, sum(regexp_matches(line, '^(#|##|###) ')::INT) OVER (PARTITION BY chunk_id, side ORDER BY n) AS grp FROM s),
    d AS (SELECT *, dense_rank() OVER (PARTITION BY chunk_id, side ORDER BY grp) - 1 AS section_idx FROM g),
    j AS (SELECT chunk_id, side, section_idx, string_agg(line, chr(10) ORDER BY n) AS body FROM d GROUP BY ALL)
    SELECT a.chunk_id, a.section_idx::INT AS section_idx, a.body AS body_a, b.body AS body_b FROM j a JOIN j b ON a.chunk_id = b.chunk_id AND a.section_idx = b.section_idx WHERE a.side = 'a' AND b.side = 'b'""")
def paired_sections(spark, sf):
    """Sections of target and reference, paired by their number."""
    t = table(spark, sf, "your_markdown", "chunk_id", "target", "reference")
    a = segment.sections(t, "chunk_id", "target", (1, 2, 3)).select("chunk_id", "section_idx", F.col("body").alias("body_a"))
    b = segment.sections(t, "chunk_id", "reference", (1, 2, 3)).select("chunk_id", "section_idx", F.col("body").alias("body_b"))
    return a.join(b, ["chunk_id", "section_idx"])


@catalogue.query("""
    SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(length(regexp_replace(text, '[^。！？!?]', '', 'g')))::BIGINT AS end_marks
    FROM documents GROUP BY lang""")
def sentence_marks(spark, sf):
    d = table(spark, sf, "documents", "lang", "text")
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(F.length(F.regexp_replace("text", "[^。！？!?]", ""))).alias("end_marks"))


@catalogue.query()
def document_sentences(spark, sf):
    return segment.sentences(table(spark, sf, "documents", "doc_id", "text"))


@catalogue.query()
def cut_chunks(spark, sf):
    return segment.cuts(table(spark, sf, "documents", "doc_id", "text"), size=600, threshold=900)


@catalogue.query()
def chunks_with_context(spark, sf):
    return segment.chunks_with_context(table(spark, sf, "documents", "doc_id", "text"))


@catalogue.query("""
    SELECT chunk_id, regexp_replace(regexp_replace(target, '!\\[[^\\]]*\\]\\([^)]*\\)(\\{[^}]*\\})?', '', 'g'), '\\n\\s*\\n+', chr(10), 'g') AS tidy FROM your_markdown WHERE target IS NOT NULL AND ascii(target) >= 0""")
def tidy_text(spark, sf):
    """Images and blank lines dropped."""
    t = table(spark, sf, "your_markdown", "chunk_id", "target").where("target is not null")
    return t.select("chunk_id", T.drop_blank_lines(T.drop_images(F.col("target"))).alias("tidy"))
