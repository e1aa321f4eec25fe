"""The package's functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import similarity
from . import text as T

#: Functions that run in Python by Arrow.
ARROW = {
    "lcs_ratio": similarity.lcs_ratio,
    "bigram_retention": similarity.bigram_retention,
    "longest_common_substring": similarity.longest_common_substring,
    "text_coverage": similarity.text_coverage,
    "best_window": similarity.best_window,
    "edit_spans": similarity.edit_spans,
}
#: Functions that are expressions of SQL.
SQL = {
    "squeeze": f"regexp_replace(s, r'{T.BLANKS}', '')",
    "fold_quotes": "translate(s, '“”‘’', '\"\"\\\'\\\'')",
    "half_width": f"translate(s, '{T.FULL_DIGITS}', '{T.HALF_DIGITS}')",
    "strip_tags": "regexp_replace(s, '<[^>]+>', '')",
    "strip_trailing_digits": "regexp_replace(s, '[0-9]+$', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and returns their names."""
    for name, function in ARROW.items():
        spark.udf.register(name, function)
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    return sorted([*ARROW, *SQL])
