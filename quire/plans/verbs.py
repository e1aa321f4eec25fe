"""The verbs: what a user runs, each one function from inputs to tables. ``python -m quire.plans.verbs VERB ...``"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, lexicon, segment, structure, writeback
from ..sources import docx, files
from . import checkpoint


def extract(spark: SparkSession, folder: str) -> DataFrame:
    """The units of all Word documents under a folder."""
    return docx.read(spark, folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, path, text``: Markdown files as they are, Word documents as Markdown."""
    text = files.texts(spark, folder)
    u = docx.read(spark, folder).where("kind <> 'error'")
    line = F.concat(F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), "heading_level"), F.lit(" "))).otherwise(""), "text")
    word = u.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return text.unionByName(word).select(F.xxhash64("path").alias("doc_id"), "path", "text")


def special(docs: DataFrame, forms: DataFrame, standard: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, phase, type, original, suggestion, start_pos, severity`` of characters, words and structure."""
    c = lexicon.character_findings(docs, forms, standard).select("doc_id", F.lit("characters").alias("phase"), F.col("kind").alias("type"), F.col("ch").alias("original"), "suggestion", F.col("pos").alias("start_pos"), lexicon.severity(F.col("kind")).alias("severity"))
    w = lexicon.word_findings(docs, words).where("word <> suggestion").select("doc_id", F.lit("words").alias("phase"), F.lit("variant_word").alias("type"), F.col("word").alias("original"), "suggestion", "start_pos", F.when(F.length("word") >= 3, "error").otherwise("warn").alias("severity"))
    s = structure.diagnostics(docs).select("doc_id", F.lit("structure").alias("phase"), F.col("kind").alias("type"), F.col("message").alias("original"), F.lit("").alias("suggestion"), "start_pos", F.when(F.col("kind") == "continuity_error", "error").otherwise("warn").alias("severity"))
    return c.unionByName(w).unionByName(s)


def book(docs: DataFrame, path: str, providers: list[tuple[str, checkpoint.Provider]], size: int = 600, **settings) -> DataFrame:
    """Sections, cut and sent to the providers, resumed from the table at ``path``; the checkpoint's last rows."""
    c = segment.chunks_with_context(docs, size=size)
    chunks = c.select(F.xxhash64("doc_id", "section_idx", "chunk_idx").alias("chunk_id"), F.sha2(F.concat_ws("\x1f", "target", "context"), 256).alias("chunk_sha256"), "target")
    return checkpoint.run_until_done(chunks, path, "book", providers, **settings)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The alignment of two versions (doc_id, text) by document."""
    side = lambda d, s: segment.sentences(d).select(F.col("doc_id").alias("pair_id"), F.lit(s).alias("side"), F.col("sent_idx").alias("idx"), F.col("sentence").alias("text"))
    return align.align(side(a, "a").unionByName(side(b, "b")))


def write_back(spark: SparkSession, folder: str, edits: DataFrame) -> DataFrame:
    """``path, content, fates``: the Word documents of a folder with their edits (path, location, current, suggested, note, comment_only).

    An edit on a document by its stem alone, as reviewers name it, meets the document of that stem.
    """
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder).select("path", "content")
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]+)?$", 1)
    named = edits.withColumn("_stem", stem(F.col("path"))).drop("path").join(files_.select("path", stem(F.col("path")).alias("_stem")), "_stem").drop("_stem")
    return writeback.write(files_, named)


VERBS = {"x": "extract", "p": "proofread", "b": "book", "d": "diff", "s": "special", "m": "max", "w": "writeback"}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("verb", choices=[*VERBS.values(), *VERBS, "structure"])
    p.add_argument("inputs", nargs="+", help="folders; for special and max also --forms, --standard, --words; for writeback a folder and a table of edits")
    p.add_argument("--out", required=True)
    p.add_argument("--forms", help="JSON lines of ch, kind, standard_ch")
    p.add_argument("--standard", help="JSON lines of ch")
    p.add_argument("--words", help="JSON lines of word, standard")
    p.add_argument("--provider", help="module:function that takes a text and gives an answer")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    verb = VERBS.get(args.verb, args.verb)
    given = lambda path, schema: spark.read.schema(schema).json(path) if path else spark.createDataFrame([], schema)

    def providers() -> list[tuple[str, checkpoint.Provider]]:
        if not args.provider:
            raise SystemExit("--provider is needed")
        module, _, name = args.provider.partition(":")
        return [(args.provider, getattr(importlib.import_module(module), name))]

    def checks(docs: DataFrame) -> DataFrame:
        return special(docs, given(args.forms, "ch string, kind string, standard_ch string"), given(args.standard, "ch string"), given(args.words, "word string, standard string"))

    if verb == "extract":
        out = extract(spark, args.inputs[0])
    elif verb == "structure":
        out = structure.diagnostics(documents(spark, args.inputs[0]))
    elif verb == "special":
        out = checks(documents(spark, args.inputs[0]))
        files.write_special(out, f"{args.out}/csv")
        args.out = f"{args.out}/rows"
    elif verb in ("proofread", "book"):
        out = book(documents(spark, args.inputs[0]), f"{args.out}/checkpoint", providers())
        args.out = f"{args.out}/rows"
    elif verb == "max":
        docs = documents(spark, args.inputs[0])
        files.write_special(checks(docs), f"{args.out}/special")
        out = book(docs, f"{args.out}/checkpoint", providers())
        args.out = f"{args.out}/rows"
    elif verb == "writeback":
        edits = spark.read.schema("path string, location string, current string, suggested string, note string, comment_only boolean").json(args.inputs[1])
        write_back(spark, args.inputs[0], edits).write.mode("errorifexists").parquet(args.out)
        return
    else:
        key = lambda d: d.select(F.xxhash64(F.regexp_extract("path", r"([^/]+)$", 1)).alias("doc_id"), "text")
        out = diff(*(key(documents(spark, x)) for x in args.inputs[:2]))
    out.write.mode("errorifexists").json(args.out)


if __name__ == "__main__":
    main()
