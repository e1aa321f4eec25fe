"""Queries on alignment: the original and the answered sentences of each chunk are a pair."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import align
from .registry import Catalogue, table

catalogue = Catalogue()

_BLANKS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _side(name: str, column: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY pair_id, norm ORDER BY {name}_index) AS k FROM (SELECT chunk_id AS pair_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY finding_id) - 1)::INT AS {name}_index, regexp_replace({column}, '{_BLANKS}', '', 'g') AS norm FROM max_pipeline WHERE {column} IS NOT NULL) WHERE norm <> '')"


_EXACT = f"""WITH {_side("a", "original_sentence")}, {_side("b", "corrected_sentence")},
    j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, a_index, b_index FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.norm = b.norm AND a.k = b.k),
    o AS (SELECT *, last_value(CASE WHEN b_index IS NOT NULL THEN a_index END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY b_index NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base,
            first_value(a_index) OVER (PARTITION BY pair_id ORDER BY (a_index IS NULL OR b_index IS NULL), b_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f1,
            max((a_index IS NOT NULL AND b_index IS NOT NULL)::INT) OVER (PARTITION BY pair_id) AS matched FROM j),
    p AS (SELECT *, CASE WHEN matched = 1 THEN f1 END AS first FROM o),
    e AS (SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN a_index IS NOT NULL THEN a_index ELSE coalesce(base, first, 2147483647) END,
                   CASE WHEN a_index IS NOT NULL THEN 0 WHEN base IS NOT NULL OR first IS NULL THEN 1 ELSE -1 END, CASE WHEN a_index IS NULL THEN b_index ELSE 0 END) - 1)::INT AS seq,
               CASE WHEN a_index IS NULL THEN 'insert' WHEN b_index IS NULL THEN 'delete' ELSE 'match' END AS type, coalesce(a_index, -1)::INT AS a_index, coalesce(b_index, -1)::INT AS b_index FROM p)"""


def _sides(spark, sf):
    f = table(spark, sf, "max_pipeline", "finding_id", "chunk_id", "original_sentence", "corrected_sentence")

    def side(column):
        rows = f.where(F.col(column).isNotNull())
        return rows.select(F.col("chunk_id").alias("pair_id"), (F.row_number().over(Window.partitionBy("chunk_id").orderBy("finding_id")) - 1).alias("idx"), F.col(column).alias("text"))

    return side("original_sentence"), side("corrected_sentence")


def _exact(spark, sf):
    return align.exact(*_sides(spark, sf))


def _both(spark, sf):
    a, b = _sides(spark, sf)
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@catalogue.query(_EXACT + " SELECT * FROM e")
def exact_sentence_alignment(spark, sf):
    return _exact(spark, sf)


@catalogue.query(_EXACT + """, u AS (SELECT *, sum(CASE WHEN type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY seq) AS unit FROM (SELECT *, lag(type) OVER (PARTITION BY pair_id ORDER BY seq) AS prev FROM e))
    SELECT pair_id, unit::INT AS unit, type, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS sentences FROM u WHERE type <> 'match' GROUP BY ALL""")
def alignment_units(spark, sf):
    return align.units(_exact(spark, sf))


@catalogue.query(_EXACT + """ SELECT pair_id, count(*) AS total, count_if(type = 'match')::BIGINT AS match, count_if(type = 'delete')::BIGINT AS delete, count_if(type = 'insert')::BIGINT AS insert, 0::BIGINT AS movein, 0::BIGINT AS moveout FROM e GROUP BY pair_id""")
def alignment_statistics(spark, sf):
    return align.statistics(_exact(spark, sf))


@catalogue.query(_EXACT + """ SELECT chunk_id AS pair_id, idx, (SELECT count(*) FROM e WHERE e.pair_id = s.chunk_id AND e.a_index = s.idx)::BIGINT AS times
    FROM (SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY finding_id) - 1)::INT AS idx FROM max_pipeline WHERE original_sentence IS NOT NULL) s WHERE times <> 1""")
def alignment_validation(spark, sf):
    """Sentences of the originals that the exact alignment misses or uses twice: none but blank ones."""
    a, _ = _sides(spark, sf)
    used = _exact(spark, sf).where("a_index >= 0").select("pair_id", F.col("a_index").alias("idx"))
    return align.validation(used, a)


@catalogue.query()
def anchor_alignment(spark, sf):
    return align.align(_both(spark, sf))


@catalogue.query()
def anchor_alignment_stages(spark, sf):
    return align.align(_both(spark, sf), stages=True).groupBy("stage", "type").agg(F.count("*").alias("items"), F.round(F.avg("similarity"), 6).alias("similarity"))


@catalogue.query()
def similarity_alignment(spark, sf):
    return align.align(_both(spark, sf), method="similarity")


@catalogue.query()
def alignment_report(spark, sf):
    """The report's filters: matches that are not quite equal."""
    return align.align(_both(spark, sf)).where("type = 'match' and similarity between 0.6 and 0.95")
