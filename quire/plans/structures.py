"""Queries on heading structure and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import locate, segment, structure
from .registry import Catalogue, spread, table

catalogue = Catalogue()

_LINES = "SELECT chunk_id, generate_subscripts(string_split(target, chr(10)), 1) AS line_no, unnest(string_split(target, chr(10))) AS line FROM your_markdown"


@catalogue.query()
def heading_tree(spark, sf):
    return structure.tree(spread(table(spark, sf, "your_markdown", "chunk_id", "target")), "chunk_id", "target")


@catalogue.query()
def structure_diagnostics(spark, sf):
    return structure.diagnostics(spread(table(spark, sf, "your_markdown", "chunk_id", "target")), "chunk_id", "target")


@catalogue.query(f"""
    WITH o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_pos FROM ({_LINES})),
    h AS (SELECT chunk_id, start_pos, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+\\S', 1))::INT AS level FROM o WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+\\S'))
    SELECT a.chunk_id, a.start_pos, a.level, coalesce((SELECT max(b.start_pos) FROM h b WHERE b.chunk_id = a.chunk_id AND b.start_pos < a.start_pos AND b.level < a.level), -1)::INT AS parent_pos FROM h a""")
def heading_parents(spark, sf):
    """The nearest earlier heading of a lower level, found within each row."""
    return locate.headings(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target").select("chunk_id", "start_pos", "level", "parent_pos")


@catalogue.query(f"""
    WITH f AS (SELECT *, regexp_matches(line, '^[ \\t]{{0,3}}(```|~~~)') AS fence, lead(line) OVER (PARTITION BY chunk_id ORDER BY line_no) AS below FROM ({_LINES})),
    s AS (SELECT *, sum(fence::INT) OVER (PARTITION BY chunk_id ORDER BY line_no) % 2 = 1 AS inside FROM f)
    SELECT chunk_id, count(*) AS lines, count_if(fence)::BIGINT AS fences, count_if(inside AND NOT fence)::BIGINT AS code_lines,
           count_if(NOT inside AND NOT fence AND trim(line, ' ') <> '' AND coalesce(regexp_matches(below, '^={{3,}}[ \\t]*\\r?$'), false))::BIGINT AS underlined FROM s GROUP BY chunk_id""")
def fenced_lines(spark, sf):
    """Lines inside code fences (an odd number of fences above) and underlined titles."""
    l = segment.to_lines(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target")
    w = Window.partitionBy("chunk_id").orderBy("line_no")
    l = l.withColumn("fence", F.col("line").rlike(r"^[ \t]{0,3}(```|~~~)")).withColumn("below", F.lead("line").over(w))
    l = l.withColumn("inside", F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    under = ~F.col("inside") & ~F.col("fence") & (F.trim("line") != "") & F.coalesce(F.col("below").rlike(r"^={3,}[ \t]*\r?$"), F.lit(False))
    return l.groupBy("chunk_id").agg(F.count("*").alias("lines"), F.count_if("fence").alias("fences"), F.count_if(F.col("inside") & ~F.col("fence")).alias("code_lines"), F.count_if(under).alias("underlined"))


@catalogue.query("""
    SELECT l_orderkey, count(*) AS lines, count_if(step IS NOT NULL AND step <> 1)::BIGINT AS jumps FROM (
        SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step FROM lineitem) GROUP BY l_orderkey""")
def numbering_continuity(spark, sf):
    """Numbers that don't follow the one before in their group."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    step = F.col("l_linenumber") - F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return l.withColumn("step", step).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("step") != 1).alias("jumps"))


@catalogue.query("""
    SELECT chunk_id, count(*) AS paragraphs, sum(length(p))::BIGINT AS characters FROM (
        SELECT chunk_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&ldquo;', '“'), '&rdquo;', '”'), '&mdash;', '—'), '&#8212;', '—'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS p
        FROM (SELECT chunk_id, unnest(string_split_regex(target, '</?(?:p|div|h[1-6]|li|tr|table|ul|br ?/?)(?: [^>]*)?>')) AS p FROM your_markdown WHERE contains(target, '<'))) WHERE p <> '' GROUP BY chunk_id""")
def html_paragraphs(spark, sf):
    """Paragraphs between block tags, without tags and entities."""
    t = table(spark, sf, "your_markdown", "chunk_id", "target").where(F.col("target").contains("<"))
    p = t.select("chunk_id", F.explode(F.split("target", r"</?(?:p|div|h[1-6]|li|tr|table|ul|br ?/?)(?: [^>]*)?>")).alias("p"))
    p = p.select("chunk_id", F.trim(F.regexp_replace(T.unescape(T.strip_tags(F.col("p"))), r"[ \t\r\n]+", " ")).alias("p")).where("p <> ''")
    return p.groupBy("chunk_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("characters"))
