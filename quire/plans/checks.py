"""Queries on filters and reasons, and on what must hold of results that SQL can't work out: nothing lost, nothing used twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, filters, locate, segment, structure
from ..sources import html
from . import alignment, findings
from .registry import Catalogue, spread, table

catalogue = Catalogue()

#: Line ends of every kind, which cutting turns into line feeds.
_ENDS = "[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
_SQUEEZE = "regexp_replace({}, '[\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')"


def _content(rows, key, order, text):
    """``key, content``: a hash of the joined pieces without line ends."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("p"))
    return g.select(key, F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), ""), T.LINE_ENDS, "").cast("binary")).alias("content"))


@catalogue.query("SELECT doc_id, md5(text) AS content FROM documents WHERE text IS NOT NULL AND trim(" + _SQUEEZE.format("text") + ") <> ''")
def sentence_content(spark, sf):
    """Sentences of each document, joined: they are the document."""
    s = segment.sentences(table(spark, sf, "documents", "doc_id", "text"))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("p"))
    return g.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["sentence"]), "").cast("binary")).alias("content"))


@catalogue.query(f"SELECT doc_id, md5(regexp_replace(text, '{_ENDS}', '', 'g')) AS content FROM documents WHERE text IS NOT NULL")
def cut_content(spark, sf):
    """Cut pieces of each document, joined: the document but for line ends."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    return _content(segment.cuts(docs, size=600, threshold=900), "doc_id", ["chunk_idx"], "target")


@catalogue.query("""SELECT doc_id, count(*) AS pieces, 0::BIGINT AS beyond FROM (SELECT doc_id, unnest(CASE WHEN length(text) <= 900 THEN [1] ELSE [] END) FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""")
def short_cuts(spark, sf):
    """Documents within the threshold come whole, in one piece; no piece of any is longer than one and a half times the size."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    c = segment.cuts(docs, size=600, threshold=900).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_if(F.length("target") > 900).alias("beyond"))
    return c.join(docs.where(F.length("text") <= 900).select("doc_id"), "doc_id", "left_semi").unionByName(c.where("beyond > 0"))


@catalogue.query(f"SELECT doc_id, md5({_SQUEEZE.format('text')}) AS content FROM documents WHERE text IS NOT NULL AND {_SQUEEZE.format('text')} <> ''")
def context_content(spark, sf):
    """Targets of the chunks with context, joined: the document but for blanks, of which whole pieces may be left out."""
    c = segment.chunks_with_context(table(spark, sf, "documents", "doc_id", "text"))
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "chunk_idx", "target"))).alias("p"))
    return g.select("doc_id", F.md5(T.squeeze(F.array_join(F.transform("p", lambda x: x["target"]), "")).cast("binary")).alias("content"))


@catalogue.query("SELECT 0::BIGINT AS without_target, 0::BIGINT AS too_long")
def context_holds_target(spark, sf):
    """Contexts that don't hold their target though they could, and contexts over the most characters: none."""
    c = segment.chunks_with_context(table(spark, sf, "documents", "doc_id", "text"), pad=800, most=3000)
    held = F.col("context").contains(T.strip(F.col("target"))) | (F.length("context") == 3000)
    return c.agg(F.count_if(~held).alias("without_target"), F.count_if(F.length("context") > 3000).alias("too_long"))


@catalogue.query(f"""
    SELECT doc_id, md5({_SQUEEZE.format('text')}) AS content FROM documents WHERE text IS NOT NULL AND {_SQUEEZE.format('text')} <> ''""")
def merged_content(spark, sf):
    """Sections, cut by length and with short pieces merged, joined: the document but for blanks."""
    c = segment.merged_cuts(table(spark, sf, "documents", "doc_id", "text"))
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_idx", "target"))).alias("p"))
    return g.select("doc_id", F.md5(T.squeeze(F.array_join(F.transform("p", lambda x: x["target"]), "")).cast("binary")).alias("content"))


_FULL = "count(*) FILTER (WHERE " + _SQUEEZE + " <> '')"
_SIDES = f"SELECT chunk_id AS pair_id, {_FULL.format('original_sentence')} AS a, {_FULL.format('corrected_sentence')} AS b FROM max_pipeline GROUP BY chunk_id HAVING a + b > 0"


def _used(rows):
    """Sentences of either side that an alignment's rows use, each counted as often as it is used; a move names both of its ends twice."""
    n = lambda c, other: F.sum(F.when(F.col("type") == other, 0).otherwise(F.coalesce(F.size(c), F.lit(0))))
    return rows.groupBy("pair_id").agg(n("a_indices", "movein").alias("a"), n("b_indices", "moveout").alias("b"))


@catalogue.query(_SIDES)
def anchor_coverage(spark, sf):
    """The anchor alignment uses every sentence of either side once."""
    return _used(align.align(alignment._both(spark, sf)))


@catalogue.query(_SIDES)
def similarity_coverage(spark, sf):
    """The alignment by similarity uses every sentence of either side once."""
    return _used(align.align(alignment._both(spark, sf), method="similarity"))


@catalogue.query("SELECT finding_id, 100.0::DOUBLE AS ratio, (instr(target, original_sentence) - 1)::INT AS position FROM max_pipeline m JOIN your_markdown c USING (chunk_id) WHERE length(original_sentence) >= 2 AND contains(target, original_sentence)")
def contained_windows(spark, sf):
    """Where a sentence stands in its chunk as it is, the window search gives its first place and 100."""
    f = table(spark, sf, "max_pipeline", "finding_id", "chunk_id", "original_sentence").where("length(original_sentence) >= 2")
    m = locate.by_similarity(f.withColumnRenamed("original_sentence", "key"), table(spark, sf, "your_markdown", "chunk_id", "target"))
    return m.where("ratio = 100").select("finding_id", "ratio", "position")


@catalogue.query(f"""SELECT CASE WHEN coalesce(original_sentence, '') = '' OR coalesce(corrected_sentence, '') = '' OR original_sentence = corrected_sentence THEN 'no_op_change'
        WHEN c.chunk_id IS NULL OR target IS NULL THEN 'match_no_location' WHEN contains(target, original_sentence) THEN 'applied' ELSE 'by_similarity' END AS outcome, count(*) AS findings
    FROM max_pipeline m LEFT JOIN your_markdown c ON m.chunk_id = c.chunk_id GROUP BY 1""")
def edit_outcomes(spark, sf):
    """Why answers are not applied to their chunks, or that they are; those compared by similarity are one outcome here."""
    return _edits(spark, sf).groupBy(F.when(F.col("exact"), F.col("outcome")).otherwise("by_similarity").alias("outcome")).agg(F.count("*").alias("findings"))


def _edits(spark, sf):
    """``finding_id, outcome, ratio, exact``: the reason of every finding, ``applied`` if there is none."""
    f = table(spark, sf, "max_pipeline", "finding_id", "chunk_id", "original_sentence", "corrected_sentence").join(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "left")
    held = F.coalesce(F.contains("target", "original_sentence"), F.lit(False))
    early = filters.edit_reason(F.col("target"), F.col("original_sentence"), F.col("corrected_sentence"), F.when(held, F.lit(100.0)))
    first = f.select("*", held.alias("held"), early.alias("early"))
    rest = first.where((F.col("early") == "match_no_location") & F.col("target").isNotNull())
    m = locate.by_similarity(rest.select("finding_id", "chunk_id", F.col("original_sentence").alias("key")), table(spark, sf, "your_markdown", "chunk_id", "target")).select("finding_id", "ratio")
    late = rest.join(m, "finding_id", "left").select("finding_id", F.coalesce(filters.edit_reason(F.col("target"), F.col("original_sentence"), F.col("corrected_sentence"), F.col("ratio")), F.lit("applied")).alias("outcome"), "ratio", F.lit(False).alias("exact"))
    settled = first.where((F.coalesce(F.col("early"), F.lit("")) != "match_no_location") | F.col("target").isNull())
    return settled.select("finding_id", F.coalesce("early", F.lit("applied")).alias("outcome"), F.when(F.col("held"), 100.0).alias("ratio"), F.lit(True).alias("exact")).unionByName(late)


@catalogue.query()
def edit_reasons(spark, sf):
    """Every finding with the reason why its answer is not applied, or ``applied``."""
    return _edits(spark, sf).drop("exact")


@catalogue.query(f"""
    WITH n AS (SELECT * FROM ({findings._NAMED}) WHERE outcome = 'located'),
    d AS (SELECT n.finding_id, c.chunk_id FROM n JOIN your_markdown o ON n.chunk_id = o.chunk_id JOIN your_markdown c ON o.book_id = c.book_id AND o.chunk_idx = c.chunk_idx AND contains(c.target, n.key))
    SELECT finding_id, CASE WHEN count(*) = 1 THEN min(chunk_id) ELSE -1 END AS chunk_id, 100.0::DOUBLE AS ratio, CASE WHEN count(*) = 1 THEN 'located' ELSE 'fuzzy_tie' END AS outcome FROM d GROUP BY finding_id""")
def delivery_anchors(spark, sf):
    """Deliveries of the chunk that hold a key are candidates for its place; more than one are a tie."""
    c = table(spark, sf, "your_markdown", "book_id", "chunk_idx", "chunk_id", "target")
    n = findings._named(spark, sf).where("outcome = 'located'").select("finding_id", F.col("chunk_id").alias("named"), "key")
    of = n.join(c.select(F.col("chunk_id").alias("named"), "book_id", "chunk_idx"), "named")
    best = locate.clear_winner(of.join(c, ["book_id", "chunk_idx"]).where(F.contains("target", "key")).select("finding_id", "chunk_id", F.lit(100.0).alias("ratio")))
    return best.fillna(-1, ["chunk_id"])


@catalogue.query("""SELECT finding_id, lower(fix_class) AS fix_class FROM max_pipeline WHERE lower(fix_class) IN ('must_fix', 'polish', 'verify') AND original_sentence IS NOT NULL AND trim(original_sentence, ' ') <> ''""")
def actionable_findings(spark, sf):
    f = table(spark, sf, "max_pipeline", "finding_id", "fix_class", "chunk_id", "original_sentence").withColumnsRenamed({"original_sentence": "original"}).withColumn("location", F.concat(F.lit("P"), "chunk_id"))
    return filters.actionable(f).select("finding_id", F.lower("fix_class").alias("fix_class"))


@catalogue.query("""SELECT finding_id, CASE WHEN length(coalesce(original_sentence, '')) < 2 THEN 'too_short' WHEN length(original_sentence) > 200 THEN 'too_long' END AS rejected FROM max_pipeline""")
def guarded_fragments(spark, sf):
    return filters.fragment_guard(table(spark, sf, "max_pipeline", "finding_id", "original_sentence"), "original_sentence").select("finding_id", "rejected")


@catalogue.query("""SELECT chunk_id FROM your_markdown WHERE regexp_matches(regexp_replace(target, '</?a( [^<>]*)?>', '', 'gi'), '<[^<>]+>')""")
def annotated_chunks(spark, sf):
    """Chunks with a tag besides those of links."""
    return table(spark, sf, "your_markdown", "chunk_id", "target").where(filters.annotated(F.col("target"))).select("chunk_id")


@catalogue.query("""SELECT m.chunk_id FROM your_markdown m WHERE chunk_idx BETWEEN 2 AND 9 AND chunk_id NOT IN (SELECT chunk_id FROM checkpoint WHERE status = 'complete' AND chunk_id IS NOT NULL)""")
def selected_chunks(spark, sf):
    """Chunks of a range of numbers that are not done."""
    c = table(spark, sf, "your_markdown", "chunk_id", "chunk_idx")
    done = table(spark, sf, "checkpoint", "chunk_id", "status").where("status = 'complete'")
    kept = filters.selected(c, None, 2, 9, column="chunk_idx")
    return kept.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id")


@catalogue.query("""SELECT style, count(*) AS findings FROM (SELECT CASE WHEN lower(fix_class) IN ('must_fix', 'polish', 'verify') THEN lower(fix_class) WHEN contains(phase, 'structure') THEN 'polish' WHEN contains(phase, 'llm') OR contains(phase, 'variant') THEN 'must_fix' ELSE 'verify' END AS style FROM max_pipeline) GROUP BY style""")
def finding_styles(spark, sf):
    f = table(spark, sf, "max_pipeline", "fix_class", "phase")
    return f.groupBy(filters.style_class(F.col("fix_class"), F.col("phase")).alias("style")).agg(F.count("*").alias("findings"))


@catalogue.query("""SELECT finding_id, '"' || left(coalesce(original_sentence, ''), 20) || '"→"' || left(coalesce(corrected_sentence, ''), 20) || '"' AS focus FROM max_pipeline""")
def focus_pairs(spark, sf):
    f = table(spark, sf, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence")
    return f.select("finding_id", filters.focus_pair(F.col("original_sentence"), F.col("corrected_sentence")).alias("focus"))


_ATX = """SELECT chunk_id, line_no, line, sum(regexp_matches(line, '^[ \\t]{0,3}(```|~~~)')::INT) OVER (PARTITION BY chunk_id ORDER BY line_no) % 2 = 1 AS fenced
    FROM (SELECT chunk_id, generate_subscripts(string_split(target, chr(10)), 1) AS line_no, unnest(string_split(target, chr(10))) AS line FROM your_markdown)"""


_NUMBER = "第([0-9]{{1,9}}|[一二三四五六七八九十百千零〇两]+)[章节]"


@catalogue.query(f"""SELECT chunk_id, line_no::INT AS line_no, regexp_extract(line, '^({_NUMBER})', 1) AS raw_text
    FROM ({_ATX}) WHERE NOT fenced AND regexp_matches(line, '^{_NUMBER}([ \\t\\x{{{{3000}}}}]|\\r?$)')""".replace("{{", "{").replace("}}", "}"))
def numbered_lines(spark, sf):
    """Chapters and sections that open a line, as the heading tree has them."""
    t = structure.tree(spread(table(spark, sf, "your_markdown", "chunk_id", "target")), "chunk_id", "target").where("rule_id in ('chapter', 'section')")
    lines = segment.to_lines(table(spark, sf, "your_markdown", "chunk_id", "target"), "chunk_id", "target").where(F.col("line").startswith("第"))
    return t.select("chunk_id", "start_pos", "raw_text").join(lines.select("chunk_id", "line_no", F.col("line_start").alias("start_pos")), ["chunk_id", "start_pos"]).select("chunk_id", "line_no", "raw_text")


_UNESCAPED = "x"
for _name, _ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("ldquo", "“"), ("rdquo", "”"), ("mdash", "—"), ("#8212", "—"), ("amp", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_ch}')"


@catalogue.query(f"""SELECT chunk_id, md5({_SQUEEZE.format(_UNESCAPED)}) AS content FROM (
    SELECT chunk_id, regexp_replace(regexp_replace(target, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g') AS x FROM your_markdown WHERE contains(target, '<')) WHERE {_SQUEEZE.format(_UNESCAPED)} <> ''""")
def page_content(spark, sf):
    """Paragraphs of pages of HTML, joined: the page without tags, comments and entities, blanks aside."""
    t = table(spark, sf, "your_markdown", "chunk_id", "target").where(F.col("target").contains("<"))
    g = html.page_paragraphs(t, "chunk_id", "target").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return g.select("chunk_id", F.md5(T.squeeze(F.array_join(F.transform("p", lambda x: x["text"]), "")).cast("binary")).alias("content"))


@catalogue.query(f"""
    WITH n AS (SELECT chunk_id, finding_id, spot, length(key) AS size, corrected_sentence AS c, count(*) OVER (PARTITION BY x.chunk_id) AS many
        FROM ({findings._NAMED}) x JOIN (SELECT finding_id, corrected_sentence FROM max_pipeline WHERE corrected_sentence IS NOT NULL) m USING (finding_id) WHERE outcome = 'located')
    SELECT n.chunk_id, substr(target, 1, spot) || c || substr(target, spot + size + 1) AS target FROM n JOIN your_markdown y ON n.chunk_id = y.chunk_id WHERE many = 1""")
def single_edits(spark, sf):
    """Chunks with one located answer, which is spliced in."""
    f = table(spark, sf, "max_pipeline", "finding_id", "corrected_sentence").where("corrected_sentence is not null")
    n = findings._named(spark, sf).where("outcome = 'located'").join(f, "finding_id")
    one = n.groupBy("chunk_id").agg(F.count("*").alias("many")).where("many = 1")
    return findings.refined_chunks(spark, sf).join(one, "chunk_id", "left_semi").select("chunk_id", "target")


@catalogue.query("""SELECT finding_id, (length(corrected_sentence) - length(original_sentence))::INT AS growth, abs(length(regexp_replace(corrected_sentence, '[^。！？!?]', '', 'g')) - length(regexp_replace(original_sentence, '[^。！？!?]', '', 'g')))::INT AS moved,
        0::BIGINT AS wrong FROM max_pipeline WHERE original_sentence IS NOT NULL AND corrected_sentence IS NOT NULL""")
def gate_measures(spark, sf):
    """Growth and moved marks of every pair of the edit gate; ``wrong`` tells where the spans' sizes don't add up to the growth."""
    g = findings.edit_gate(spark, sf)
    return g.select("finding_id", "growth", "moved", (F.col("added") - F.col("changed") != F.col("growth")).cast("long").alias("wrong"))
