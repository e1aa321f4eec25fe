"""Queries on findings: where they are, what the checkpoints hold, how they add up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as T
from ..operators import locate
from . import checkpoint as cp
from .registry import Catalogue, spread, table

catalogue = Catalogue()

_KEYED = "SELECT finding_id, book_id, chunk_id, regexp_replace(trim(original_sentence, ' '), '^(#{1,6}\\s+|[-*+]\\s+)', '') AS key FROM max_pipeline"
_NAMED = f"""SELECT finding_id, f.book_id, f.chunk_id, key,
        CASE WHEN coalesce(regexp_replace(key, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]', '', 'g'), '') = '' THEN 'empty_key_text' WHEN target IS NULL THEN 'p_out_of_range' WHEN instr(target, key) > 0 THEN 'located' ELSE 'not_in_chunk' END AS outcome,
        instr(target, key) - 1 AS spot, target
    FROM ({_KEYED}) f LEFT JOIN your_markdown c ON f.chunk_id = c.chunk_id"""


def _named(spark, sf):
    f = table(spark, sf, "max_pipeline", "finding_id", "book_id", "chunk_id", "original_sentence")
    return locate.in_named_chunk(f, table(spark, sf, "your_markdown", "chunk_id", "target"))


def _keys(spark, sf):
    f = table(spark, sf, "max_pipeline", "finding_id", "book_id", "original_sentence")
    key = locate.key_text(F.col("original_sentence"))
    return f.select("finding_id", "book_id", key.alias("key"), (F.length(T.squeeze(F.coalesce(key, F.lit("")))) == 0).alias("blank"))


def _residual(spark, sf):
    return _named(spark, sf).where("outcome in ('not_in_chunk', 'p_out_of_range')")


@catalogue.query(f"""SELECT finding_id, chunk_id, outcome, (CASE WHEN outcome = 'located' THEN spot ELSE -1 END)::INT AS position,
    (CASE WHEN outcome = 'located' THEN (length(target) - length(replace(target, key, ''))) // length(key) ELSE 0 END)::INT AS occurrences FROM ({_NAMED})""")
def exact_locate(spark, sf):
    return _named(spark, sf).select("finding_id", "chunk_id", "outcome", "position", "occurrences")


@catalogue.query(f"""
    WITH k AS (SELECT finding_id, book_id, key FROM ({_NAMED}) WHERE outcome <> 'empty_key_text' AND key <> '')
    SELECT k.finding_id, count(*) AS chunks, min(c.chunk_id) AS chunk_id FROM k JOIN your_markdown c ON k.book_id = c.book_id AND contains(c.target, k.key) GROUP BY k.finding_id""")
def book_locate(spark, sf):
    """Chunks of the book that hold a key, whatever chunk the finding names; more than one is a duplicate anchor."""
    return locate.in_book(_keys(spark, sf).where(~F.col("blank")), spread(table(spark, sf, "your_markdown", "book_id", "chunk_id", "target")))


@catalogue.query(f"""
    WITH k AS (SELECT finding_id, book_id, key FROM ({_NAMED}) WHERE key <> ''),
    n AS (SELECT k.finding_id, count(*) AS chunks FROM k JOIN your_markdown c ON k.book_id = c.book_id AND contains(c.target, k.key) GROUP BY k.finding_id)
    SELECT CASE WHEN outcome = 'empty_key_text' THEN 'empty_key_text' WHEN chunks IS NULL THEN 'not_found' WHEN chunks > 1 THEN 'duplicate_anchor' ELSE 'located' END AS outcome, count(*) AS findings
    FROM ({_NAMED}) f LEFT JOIN n USING (finding_id) GROUP BY 1""")
def anchor_outcomes(spark, sf):
    """What becomes of findings that name no chunk: their key must stand in one chunk of the book alone."""
    n = _keys(spark, sf)
    found = locate.in_book(n.where(~F.col("blank")), spread(table(spark, sf, "your_markdown", "book_id", "chunk_id", "target")))
    outcome = F.when(F.col("blank"), "empty_key_text").when(F.col("chunks").isNull(), "not_found").when(F.col("chunks") > 1, "duplicate_anchor").otherwise("located")
    return n.join(found.drop("chunk_id"), "finding_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("findings"))


@catalogue.query()
def fuzzy_locate(spark, sf):
    r = _residual(spark, sf).where("outcome = 'not_in_chunk'").select("finding_id", "chunk_id", "key")
    return locate.by_similarity(spread(r), table(spark, sf, "your_markdown", "chunk_id", "target"))


@catalogue.query(f"SELECT outcome, count(*) AS findings FROM ({_NAMED}) GROUP BY outcome")
def locate_outcomes(spark, sf):
    return _named(spark, sf).groupBy("outcome").agg(F.count("*").alias("findings"))


@catalogue.query(f"""SELECT finding_id, CASE WHEN spot > 60 THEN '…' ELSE '' END || trim(regexp_replace(substr(target, greatest(spot - 60, 0) + 1, least(spot + length(key) + 60, length(target)) - greatest(spot - 60, 0)), '[\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ') || CASE WHEN spot + length(key) + 60 < length(target) THEN '…' ELSE '' END AS context
    FROM ({_NAMED}) WHERE outcome = 'located'""")
def finding_context(spark, sf):
    n = _named(spark, sf).where("outcome = 'located'")
    j = n.join(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id")
    return j.select("finding_id", T.window(F.col("target"), F.col("position"), F.col("position") + F.length("key")).alias("context"))


@catalogue.query(f"""
    WITH l AS (SELECT chunk_id, target, generate_subscripts(string_split(target, chr(10)), 1) AS n, unnest(string_split(target, chr(10))) AS line FROM your_markdown),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM l),
    h AS (SELECT chunk_id, start_pos, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+\\S', 1)) AS level, regexp_replace(line, '^#{{1,6}}[ \\t]+', '') AS title, length(target) AS size FROM o WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+\\S'))
    SELECT a.chunk_id, a.start_pos::INT AS start_pos, a.level::INT AS level, a.title, coalesce((SELECT min(b.start_pos) FROM h b WHERE b.chunk_id = a.chunk_id AND b.start_pos > a.start_pos AND b.level <= a.level + 1), a.size)::INT AS end_pos FROM h a""")
def chapter_map(spark, sf):
    return locate.headings(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target").drop("parent_pos")


@catalogue.query(f"""
    WITH l AS (SELECT chunk_id, generate_subscripts(string_split(target, chr(10)), 1) AS n, unnest(string_split(target, chr(10))) AS line FROM your_markdown),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM l),
    h AS (SELECT chunk_id, start_pos, regexp_replace(line, '^#{{1,6}}[ \\t]+', '') AS title FROM o WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+\\S')),
    p AS (SELECT finding_id, chunk_id, spot AS position FROM ({_NAMED}) WHERE outcome = 'located')
    SELECT p.finding_id, p.chunk_id, p.position::INT AS position, h.title AS chapter FROM p ASOF LEFT JOIN h ON p.chunk_id = h.chunk_id AND p.position >= h.start_pos""")
def chapter_lookup(spark, sf):
    points = _named(spark, sf).where("outcome = 'located'").select("finding_id", "chunk_id", "position")
    return locate.chapter_of(points, locate.headings(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target"), "chunk_id")


@catalogue.query()
def refined_chunks(spark, sf):
    """Chunks with the located answers spliced in, from right to left."""
    f = table(spark, sf, "max_pipeline", "finding_id", "corrected_sentence")
    n = _named(spark, sf).where("outcome = 'located'").join(f.where("corrected_sentence is not null"), "finding_id")
    edits = n.select("chunk_id", F.col("position").alias("start_pos"), F.length("key").alias("length"), F.col("corrected_sentence").alias("replacement"))
    return locate.apply_replacements(table(spark, sf, "your_markdown", "chunk_id", "target"), edits, "chunk_id", "target")


@catalogue.query("SELECT phase, coalesce(lower(fix_class), 'none') AS fix_class, count(*) AS findings, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warn')::BIGINT AS warnings, count_if(severity = 'info')::BIGINT AS notes, round(avg(confidence), 6) AS confidence FROM max_pipeline GROUP BY ALL")
def finding_counts(spark, sf):
    f = table(spark, sf, "max_pipeline", "phase", "fix_class", "severity", "confidence")
    level = lambda x: F.count_if(F.col("severity") == x)
    return f.groupBy("phase", F.coalesce(F.lower("fix_class"), F.lit("none")).alias("fix_class")).agg(F.count("*").alias("findings"), level("error").alias("errors"), level("warn").alias("warnings"), level("info").alias("notes"), F.round(F.avg("confidence"), 6).alias("confidence"))


@catalogue.query("SELECT reason, count(*) AS skipped, count(detail) AS detailed, count(DISTINCT chunk_id) AS chunks, round(avg(s.ratio), 6) AS ratio FROM skipped s LEFT JOIN max_pipeline m USING (finding_id) GROUP BY reason")
def skipped_reasons(spark, sf):
    s = table(spark, sf, "skipped", "finding_id", "reason", "detail", "ratio")
    m = table(spark, sf, "max_pipeline", "finding_id", "chunk_id")
    return s.join(m, "finding_id", "left").groupBy("reason").agg(F.count("*").alias("skipped"), F.count("detail").alias("detailed"), F.countDistinct("chunk_id").alias("chunks"), F.round(F.avg("ratio"), 6).alias("ratio"))


_READABLE = "(json_extract(CASE WHEN json_valid(findings_json) THEN findings_json END, '$.findings') IS NOT NULL OR json_extract(CASE WHEN json_valid(findings_json) THEN findings_json END, '$.issues') IS NOT NULL OR regexp_matches(trim(findings_json, ' '), '^\\[[\\s\\S]*\\]$'))"


@catalogue.query(f"""
    SELECT run_key, chunk_id, book_id, kind FROM (SELECT *, 'run-' || book_id || '-0' AS run_key FROM your_markdown) c WHERE NOT EXISTS (
        SELECT 1 FROM checkpoint p WHERE p.run_key = c.run_key AND p.chunk_id = c.chunk_id AND p.chunk_sha256 = c.chunk_sha256 AND p.status = 'complete' AND {_READABLE})""")
def checkpoint_pending(spark, sf):
    """What the run of each book has still to do."""
    chunks = table(spark, sf, "your_markdown", "chunk_id", "chunk_sha256", "book_id", "kind")
    have = table(spark, sf, "checkpoint", "run_key", "chunk_id", "chunk_sha256", "status", "findings_json")
    return cp.pending(chunks.withColumn("run_key", F.concat(F.lit("run-"), "book_id", F.lit("-0"))), have).select("run_key", "chunk_id", "book_id", "kind")


@catalogue.query("""
    SELECT coalesce(status, 'none') AS status, count(*) AS chunks, count(error) AS errors FROM (
        SELECT *, row_number() OVER (PARTITION BY run_key, chunk_id ORDER BY updated_at DESC, coalesce(status, '') DESC) AS rn FROM checkpoint) WHERE rn = 1 GROUP BY ALL""")
def checkpoint_stats(spark, sf):
    return cp.latest(table(spark, sf, "checkpoint", "run_key", "chunk_id", "status", "error", "updated_at")).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("chunks"), F.count("error").alias("errors"))


@catalogue.query("""
    SELECT run_key, chunk_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) WHEN json_extract(j, '$.findings') IS NOT NULL THEN json_array_length(j, '$.findings')
             WHEN json_array_length(j, '$.issues') > 0 THEN json_array_length(j, '$.issues') ELSE -1 END::INT AS findings, updated_at
    FROM (SELECT *, CASE WHEN json_valid(findings_json) THEN findings_json::JSON END AS j FROM checkpoint) WHERE findings_json IS NOT NULL""")
def json_findings_extract(spark, sf):
    """Number of findings in each answer; -1 where it is no answer."""
    c = table(spark, sf, "checkpoint", "run_key", "chunk_id", "findings_json", "updated_at").where("findings_json is not null")
    return c.select("run_key", "chunk_id", F.coalesce(F.size(T.json_findings(F.col("findings_json"))), F.lit(-1)).alias("findings"), "updated_at")


@catalogue.query()
def edit_gate(spark, sf):
    """Whether an answer is small enough to be written as an edit: short spans, kept bigrams, no boundary moved."""
    f = spread(table(spark, sf, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence").where("original_sentence is not null and corrected_sentence is not null"))
    f = f.withColumn("spans", F.filter(similarity.edit_spans("original_sentence", "corrected_sentence"), lambda s: s["tag"] != "equal"))
    total = lambda low, high: F.aggregate("spans", F.lit(0), lambda a, s: a + s[high] - s[low])
    marks = lambda c: F.regexp_count(c, F.lit("[。！？!?]"))
    f = f.select("finding_id", total("a1", "a2").alias("changed"), total("b1", "b2").alias("added"), (F.length("corrected_sentence") - F.length("original_sentence")).alias("growth"), F.coalesce(similarity.bigram_retention("original_sentence", "corrected_sentence"), F.lit(0.0)).alias("retention"), F.abs(marks("corrected_sentence") - marks("original_sentence")).alias("moved"))
    small = (F.col("changed") <= 2) & (F.col("added") <= 4) & (F.abs("growth") <= 4)
    kept = (F.col("changed") <= 30) & (F.col("added") <= 30) & (F.col("retention") >= F.when(F.col("changed") <= 4, 0.10).otherwise(0.35)) & (F.col("moved") <= 1)
    return f.withColumn("retention", F.round("retention", 3)).withColumn("allowed", small | kept)
