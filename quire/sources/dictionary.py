"""Dictionaries as tables (dict, entry, paraphrase): packed definitions, lookups, and printed lists of variants."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import text as X
from ..operators.dictionary import plain, split_variants


@arrow_udf(T.StringType())
def unpacked(c: pa.Array) -> pa.Array:
    """Definitions from their zlib form; null for what is none."""

    def one(data):
        try:
            return None if data is None else zlib.decompress(data).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return pa.array([one(x) for x in c.to_pylist()], pa.string())


def entries(dictionary: DataFrame, limit: int | None = None) -> DataFrame:
    e = dictionary.select("dict", "entry")
    return e.orderBy("dict", "entry").limit(limit) if limit is not None else e


def info(dictionary: DataFrame) -> DataFrame:
    """Entries and distinct headwords of each dictionary."""
    return dictionary.groupBy("dict").agg(F.count("*").alias("entries"), F.countDistinct("entry").alias("headwords"))


def look_up(terms: DataFrame, dictionary: DataFrame, order: str = "row_id") -> DataFrame:
    """``term, dict, text``: the first definition of each term (term) in each dictionary, without tags; a term that none has is left out.

    The first is that of the least ``order``, a column of the dictionary, or without one of the least content.
    """
    asked = dictionary.join(terms.select(F.col("term").alias("entry")).distinct(), "entry", "left_semi")
    rank = F.struct(*([order] if order in dictionary.columns else []), "paraphrase")
    first = asked.groupBy("dict", "entry").agg(F.min_by("paraphrase", rank).alias("paraphrase"))
    return first.select(F.col("entry").alias("term"), "dict", plain(unpacked("paraphrase")).alias("text"))


def known(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The words (word) that a dictionary has."""
    return words.join(dictionary.select(F.col("entry").alias("word")).distinct(), "word", "left_semi")


def extracted(dictionary: DataFrame, rules: DataFrame) -> DataFrame:
    """``dict, entry, kind, value`` by rules (dict, kind, pattern): the first group of each match, tags off, each once.

    The patterns of a dictionary's dialect are rows, so a new dialect is no new code.
    """
    j = dictionary.select("dict", "entry", unpacked("paraphrase").alias("text")).join(rules, "dict")
    hits = j.select("dict", "entry", "kind", F.explode(F.regexp_extract_all("text", F.col("pattern"), F.lit(1))).alias("value"))
    return hits.select("dict", "entry", "kind", F.trim(plain(F.col("value"))).alias("value")).where("value <> ''").distinct()


def headwords(dictionary: DataFrame) -> DataFrame:
    """``headword, dictionaries`` in order of the headword."""
    w = dictionary.where(X.is_headword(F.col("entry"))).select("dict", F.col("entry").alias("headword")).distinct()
    return w.groupBy("headword").agg(F.count("*").alias("dictionaries")).orderBy("headword")


def variant_list(spark: SparkSession, path: str) -> DataFrame:
    """``standard, variant, note`` of a printed list: ``甲（乙、丙*）``, ``甲—乙`` or ``甲［乙］``, a note's number behind; notes are lines ``①text``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    notes = lines.where(F.col("line").rlike("^[①-⑳]")).select(F.substring("line", 1, 1).alias("mark"), F.trim(F.substring("line", 2, 10000)).alias("note"))
    shape = r"^([\x{4e00}-\x{9fff}]+)\s*(?:（([^）]+)）|［([^］]+)］|[—–-]+\s*([^①-⑳]+?))\s*([①-⑳]?)$"
    rows = lines.where(F.col("line").rlike(shape))
    part = lambda k: F.regexp_extract("line", shape, k)
    each = rows.select(part(1).alias("standard"), F.explode(split_variants(F.concat(part(2), part(3), part(4)))).alias("variant"), part(5).alias("mark"))
    return each.join(notes, "mark", "left").select("standard", "variant", "note").distinct()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``head, label, raw`` of a three-column table of additions; rows without a head or a record are left out."""
    t = spark.read.csv(path, schema="head string, label string, raw string", mode="PERMISSIVE")
    return t.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("head", "label", "raw"))).where("head is not null and raw is not null")


def bigrams(spark: SparkSession, path: str) -> DataFrame:
    """``bigram, frequency, pattern`` of a frequency file; D and L stand for any digit and letter."""
    t = spark.read.csv(path, sep="\t", schema="bigram string, frequency double").where("bigram is not null")
    return t.withColumn("pattern", F.replace(F.replace("bigram", F.lit("D"), F.lit("[0-9]")), F.lit("L"), F.lit("[A-Za-z]")))
