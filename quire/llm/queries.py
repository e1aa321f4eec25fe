"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, garbled, leakage, lookalike, markup, packing, pairs, pieces, repetition, sentences

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": pairs.found,
        "p1_defects": pairs.flagged,
        "p2_found": markup.found,
        "p2_clean": markup.clean_text,
        "p3_found": pieces.found,
        "p3_pieces": pieces.assembled,
        "p4_found": sentences.found,
        "p4_units": sentences.units,
        "p5_found": garbled.found,
        "p5_repairs": garbled.repairs,
        "p6_found": lookalike.found,
        "p6_forms": lookalike.forms,
        "p7_found": packing.found,
        "p7_assignment": packing.assignment,
        "p7_fill": packing.fill,
        "p8_found": leakage.found,
        "p8_pairs": leakage.pairs,
        "p9_found": repetition.found,
        "p9_shares": repetition.shares,
        "p1_plain_defects": checks.plain_defects,
        "p3_piece_cover": checks.piece_cover,
        "p4_sentence_cover": checks.sentence_cover,
        "p5_damaged": checks.damaged,
        "p6_plain_forms": checks.plain_forms,
        "p7_balance": checks.packing_balance,
        "p8_leaked": checks.leaked_pairs,
        "p9_letters": checks.repeated_letters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT chunk_id, 'target' AS field FROM your_markdown JOIN split_settings USING (profile) WHERE length(target) > cut_by
            UNION ALL
            SELECT chunk_id, 'context' AS field FROM your_markdown JOIN split_settings USING (profile) WHERE length(context) > max_context""",
        "p9_found": r"""
            WITH t AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS s FROM documents),
            g AS (SELECT doc_id, i, substr(s, i, 30) AS gram FROM (SELECT doc_id, s, unnest(range(1, length(s) - 28)) AS i FROM t WHERE length(s) > 30)),
            r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS n FROM g) WHERE n > 1),
            c AS (SELECT doc_id, count(DISTINCT i + k) AS covered FROM r, range(0, 30) o(k) GROUP BY doc_id)
            SELECT doc_id FROM c JOIN t USING (doc_id) WHERE covered >= 0.3 * length(s)""",
        "p1_plain_defects": checks.PLAIN_DEFECTS,
        "p3_piece_cover": checks.PIECE_COVER,
        "p4_sentence_cover": checks.SENTENCE_COVER,
        "p5_damaged": checks.DAMAGED,
        "p6_plain_forms": checks.PLAIN_FORMS,
        "p7_balance": checks.PACKING_BALANCE,
        "p8_leaked": checks.LEAKED_PAIRS,
        "p8_found": checks.LEAKED_PAIRS,
        "p9_letters": checks.REPEATED_LETTERS,
        "p7_found": "SELECT doc_id, container_kind FROM documents, containers WHERE octet_length(encode(text)) > capacity",
    }
