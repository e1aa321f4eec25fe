"""Queries on features, n-gram models, hashes and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, ordered
from .registry import Catalogue, spread, table

catalogue = Catalogue()

_WORDS = "SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents)"
_BIGRAMS = f"SELECT * FROM (SELECT word AS w1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM ({_WORDS})) WHERE w2 IS NOT NULL"


def _ratio(pattern: str) -> str:
    return f"round((length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))::DOUBLE / greatest(length(text), 1), 6)"


@catalogue.query(f"""
    SELECT doc_id, {_ratio('[\\x{4e00}-\\x{9fff}]')} AS han_share, {_ratio('[A-Za-z]')} AS latin_share, {_ratio('[0-9]')} AS digit_share,
           {_ratio('[，,、]')} AS comma_share, {_ratio('[。.]')} AS stop_share, {_ratio('[？?！!]')} AS ask_share, length(text)::INT AS length,
           len(regexp_extract_all(text, '[0-9]+'))::INT AS numbers,
           round(CASE WHEN len(regexp_extract_all(text, '[0-9]+')) > 0 THEN (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END, 6) AS number_length
    FROM documents""".replace("{4e00}", "{4e00}"))
def character_features(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    f = T.features(F.col("text"))
    keep = ["han_share", "latin_share", "digit_share", "comma_share", "stop_share", "ask_share", "length", "numbers", "number_length"]
    return d.select("doc_id", *(F.round(f[k], 6).alias(k) if k not in ("length", "numbers") else f[k].alias(k) for k in keep))


@catalogue.query(f"SELECT word AS headword, count(DISTINCT doc_id) AS documents FROM ({_WORDS}) WHERE length(word) >= 2 AND NOT regexp_matches(word, '[\\p{{Nd}}\\p{{No}}A-Za-z]') GROUP BY word")
def headword_document_frequency(spark, sf):
    return models.document_frequency(models.words(table(spark, sf, "documents", "doc_id", "text")))


@catalogue.query(f"WITH b AS ({_BIGRAMS}) SELECT w1, w2, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM b), 12) AS probability FROM b GROUP BY w1, w2")
def word_bigram_model(spark, sf):
    m = models.bigram_model(models.bigrams(table(spark, sf, "documents", "doc_id", "text")))
    return m.withColumn("probability", F.round("probability", 12))


@catalogue.query(f"""
    WITH b AS (SELECT doc_id, pos, word AS w1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM ({_WORDS})), c AS (SELECT * FROM b WHERE w2 IS NOT NULL),
    m AS (SELECT w1, w2, count(*)::DOUBLE / (SELECT count(*) FROM c) AS p FROM c GROUP BY w1, w2)
    SELECT doc_id, count(*) AS rare_bigrams FROM c JOIN m USING (w1, w2) WHERE p < 0.0001 GROUP BY doc_id""")
def rare_bigrams(spark, sf):
    return models.rare_bigrams(models.bigrams(table(spark, sf, "documents", "doc_id", "text")), 1e-4)


@catalogue.query("SELECT chunk_id, sha256(target) AS target_sha256, left(sha256(target), 20) AS run_key, chunk_sha256 IS NOT NULL AND chunk_sha256 <> sha256(target) AS stale FROM your_markdown WHERE target IS NOT NULL")
def chunk_hashes(spark, sf):
    t = table(spark, sf, "your_markdown", "chunk_id", "target", "chunk_sha256").where("target is not null")
    h = F.sha2("target", 256)
    return t.select("chunk_id", h.alias("target_sha256"), F.left(h, F.lit(20)).alias("run_key"), (F.col("chunk_sha256").isNotNull() & (F.col("chunk_sha256") != h)).alias("stale"))


@catalogue.query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def first_seen_documents(spark, sf):
    """The first of each group of equal texts; aggregated by hash, so copies meet as counts and not as rows."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@catalogue.query("""
    SELECT finding_id, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 WHEN a = b THEN 1.0 ELSE round(len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))), 6) END AS similarity
    FROM (SELECT *, CASE WHEN length(a) < 2 THEN [a] ELSE list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) END AS ga,
                    CASE WHEN length(b) < 2 THEN [b] ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) END AS gb
          FROM (SELECT finding_id, replace(original_sentence, ' ', '') AS a, replace(corrected_sentence, ' ', '') AS b FROM max_pipeline WHERE original_sentence IS NOT NULL AND corrected_sentence IS NOT NULL))""")
def answer_similarity(spark, sf):
    """Bigram similarity of the original and its answer, spaces aside."""
    f = spread(table(spark, sf, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence").where("original_sentence is not null and corrected_sentence is not null"))
    a, b = F.replace("original_sentence", F.lit(" "), F.lit("")), F.replace("corrected_sentence", F.lit(" "), F.lit(""))
    return f.select("finding_id", F.round(T.jaccard(a, b), 6).alias("similarity"))


@catalogue.query("""
    WITH g AS (SELECT finding_id, side, gram, count(*) AS n FROM (
                 SELECT finding_id, 'a' AS side, substr(original_sentence, i::INT, 2) AS gram FROM (SELECT *, unnest(range(1, length(original_sentence))) AS i FROM max_pipeline WHERE corrected_sentence IS NOT NULL)
                 UNION ALL SELECT finding_id, 'b', substr(corrected_sentence, i::INT, 2) FROM (SELECT *, unnest(range(1, length(corrected_sentence))) AS i FROM max_pipeline WHERE original_sentence IS NOT NULL)) GROUP BY ALL),
    t AS (SELECT finding_id, sum(n) AS total FROM g WHERE side = 'a' GROUP BY 1),
    k AS (SELECT a.finding_id, sum(least(a.n, b.n)) AS kept FROM g a JOIN g b ON a.finding_id = b.finding_id AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY 1)
    SELECT t.finding_id, round(coalesce(kept, 0)::DOUBLE / total, 3) AS retention FROM t LEFT JOIN k USING (finding_id)""")
def bigram_retention(spark, sf):
    """Share of the original's bigrams, counted as often as they occur, that the answer keeps."""
    f = spread(table(spark, sf, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence").where("original_sentence is not null and corrected_sentence is not null"))
    return models.retention(f, "finding_id", "original_sentence", "corrected_sentence")


@catalogue.query("""
    SELECT user_id, count(*) AS calls, count_if(gap < 60)::BIGINT AS too_soon FROM (
        SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id""")
def rate_gaps(spark, sf):
    """Calls of each caller that came less than a minute after the one before."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts")
    e = ordered.with_previous(e, "user_id", F.to_date("ts"), ["ts", "event_id"], "ts", "before")
    soon = (F.col("ts") - F.col("before")) < F.expr("INTERVAL '60' SECOND")
    return e.withColumn("soon", soon).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("soon")).alias("too_soon"))


@catalogue.query()
def quality_tree(spark, sf):
    """Faulty sentences and their answers with the class a shallow decision tree gives them: 1 is faulty."""
    f = table(spark, sf, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence")
    side = lambda column, label: f.select(F.col("finding_id").alias("id"), F.col(column).alias("text"), F.lit(label).alias("label"))
    return models.tree_classes(side("original_sentence", 1).unionByName(side("corrected_sentence", 0)))
