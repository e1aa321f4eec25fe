"""A light check of running text: known wrong words, rare word pairs, doubled marks, numbers parted from their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon, models

#: Marks that stand after another mark, and units after a number and blanks.
DOUBLED = r"([，。！？、；：])\1+"
UNITS = "千米|公里|厘米|毫米|米|公斤|千克|克|吨|元|年|月|日|人|个|页|卷"
PARTED = rf"[0-9]+[ \x{{3000}}]+(?:{UNITS})"
#: How sure a finding of each kind is.
SURE = {"word_error": 0.9, "ngram_error": 0.6, "punctuation": 0.7, "number_unit": 0.8}
FOUND = "start_pos int, end_pos int, original string, suggestion string"


def _matches(docs: DataFrame, pattern: str, kind: str, suggestion: Column, key: str, text: str) -> DataFrame:
    """The matches of a pattern, in order: the text is split at them, so places are sums of lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(F.col(text), pattern)
    before = F.aggregate(
        F.arrays_zip(F.slice(rest, 1, F.size(whole)).alias("r"), whole.alias("w")),
        F.array().cast("array<struct<at:int,w:string>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["at"] + F.length(F.try_element_at(acc, F.lit(-1))["w"]), F.lit(0)) + F.length(x["r"])).alias("at"), x["w"].alias("w")))),
    )
    hits = docs.where(F.col(text).rlike(pattern)).select(key, F.inline(before))
    return hits.select(key, F.lit(kind).alias("kind"), F.col("at").alias("start_pos"), (F.col("at") + F.length("w")).cast("int").alias("end_pos"), F.col("w").alias("original"), suggestion.alias("suggestion"))


def check_text(docs: DataFrame, words: DataFrame, below: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, start_pos, end_pos, original, suggestion, confidence`` of all findings.

    ``words``: (word, standard), of which each text's first occurrence counts. With ``below``, pairs of words between blanks that are rarer
    than that among all documents' pairs come too, by their first place. Null texts have no findings.
    """
    docs = docs.where(F.col(text).isNotNull()).select(key, text)
    first = lexicon.first_occurrences(lexicon.word_findings(docs, words, key, text), key).where("word <> suggestion")
    found = first.select(key, F.lit("word_error").alias("kind"), "start_pos", (F.col("start_pos") + F.length("word")).cast("int").alias("end_pos"), F.col("word").alias("original"), "suggestion")
    found = found.unionByName(_matches(docs, DOUBLED, "punctuation", F.left("w", F.lit(1)), key, text))
    found = found.unionByName(_matches(docs, PARTED, "number_unit", F.regexp_replace("w", r"[ \x{3000}]+", ""), key, text))
    if below is not None:
        pairs = models.bigrams(docs, key, text)
        rare = pairs.distinct().join(models.bigram_model(pairs).where(F.col("probability") < below).select("w1", "w2"), ["w1", "w2"]).join(docs, key)
        both = F.concat("w1", F.lit(" "), "w2")
        found = found.unionByName(rare.where(F.contains(text, both)).select(key, F.lit("ngram_error").alias("kind"), (F.instr(text, both) - 1).alias("start_pos"), (F.instr(text, both) - 1 + F.length(both)).cast("int").alias("end_pos"), both.alias("original"), F.lit("").alias("suggestion")))
    sure = F.create_map(*(F.lit(x) for pair in SURE.items() for x in pair))
    return found.withColumn("confidence", sure[F.col("kind")])


def corrections(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits (key, start_pos, length, replacement) of findings: rare pairs are put in brackets, all others become their suggestion."""
    by = F.when(F.col("kind") == "ngram_error", F.concat(F.lit("["), "original", F.lit("]"))).otherwise(F.col("suggestion"))
    return found.select(key, "start_pos", (F.col("end_pos") - F.col("start_pos")).alias("length"), by.alias("replacement"))
