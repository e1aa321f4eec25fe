"""Layout analysis in JSON: pages of blocks of lines of spans, to Markdown, content lists and footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = "struct<type:string,content:string,image_path:string,html:string,latex:string,original_label:string>"
BLOCK = f"struct<type:string,level:int,bbox:array<double>,lines:array<struct<spans:array<{SPAN}>>>>"
PAGES = f"doc_id long, pages array<struct<page_idx:int,page_size:array<double>,para_blocks:array<{BLOCK}>,discarded_blocks:array<{BLOCK}>>>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a block: ``doc_id, page, block, kept, type, level, bbox, lines``; boxes in thousandths of the page."""
    docs = spark.read.schema(PAGES).json(folder, multiLine=True)
    pages = docs.select("doc_id", F.explode("pages").alias("p"))

    def blocks(column: str, kept: bool) -> DataFrame:
        b = pages.select("doc_id", F.col("p.page_idx").alias("page"), F.col("p.page_size").alias("size"), F.posexplode(F.col(f"p.{column}")).alias("block", "b"))
        box = F.transform("b.bbox", lambda v, i: (v * 1000 / F.col("size")[i % 2]).cast("int"))
        return b.select("doc_id", "page", "block", F.lit(kept).alias("kept"), "b.type", "b.level", box.alias("bbox"), "b.lines")

    return blocks("para_blocks", True).unionByName(blocks("discarded_blocks", False))


def span_text(span: Column) -> Column:
    """What a span says: its content, formulas in dollar signs, tables by their HTML."""
    return F.when(span["type"] == "inline_equation", F.concat(F.lit("$"), F.coalesce(span["latex"], span["content"]), F.lit("$"))).otherwise(F.coalesce(span["content"], span["latex"], span["html"], F.lit("")))


def joined(lines: Column) -> Column:
    """Lines as one text: Latin lines with a blank between, without the hyphen of a broken word; others directly."""
    texts = F.transform(lines, lambda l: F.array_join(F.transform(l["spans"], span_text), ""))

    def add(acc: Column, line: Column) -> Column:
        latin = acc.rlike(r"[A-Za-z0-9,.;:!?)]$") & line.rlike(r"^[A-Za-z0-9(]")
        return F.when(acc.rlike("[A-Za-z]-$") & line.rlike("^[a-z]"), F.concat(F.regexp_replace(acc, "-$", ""), line)).when(latin, F.concat(acc, F.lit(" "), line)).otherwise(F.concat(acc, line))

    return F.aggregate(texts, F.lit(""), add)


def is_footnote(lines: Column) -> Column:
    return F.exists(lines, lambda l: F.exists(l["spans"], lambda s: s["original_label"] == "footnote"))


def content_list(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block, type, level, bbox, text`` of the kept blocks; levels of titles are 0 to 4."""
    level = F.when(F.col("type") == "title", F.greatest(F.lit(0), F.least(F.lit(4), F.coalesce("level", F.lit(1)))))
    return blocks.where("kept").select("doc_id", "page", "block", "type", level.alias("level"), "bbox", joined(F.col("lines")).alias("text"))


def markdown(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: titles with their marks, equations in double dollar signs, images as links; blank lines between."""
    c = content_list(blocks)
    image = F.flatten(F.transform("lines", lambda l: F.filter(F.transform(l["spans"], lambda s: s["image_path"]), lambda p: p.isNotNull())))
    images = blocks.where("kept").select("doc_id", "page", "block", F.array_join(F.transform(image, lambda p: F.concat(F.lit("![]("), p, F.lit(")"))), "\n").alias("images"))
    text = F.when(F.col("type") == "title", F.concat(F.repeat(F.lit("#"), F.greatest("level", F.lit(1))), F.lit(" "), F.col("text"))).when(F.col("type") == "interline_equation", F.concat(F.lit("$$\n"), F.col("text"), F.lit("\n$$"))).otherwise(F.concat_ws("\n", F.when(F.col("images") != "", F.col("images")), F.when(F.col("text") != "", F.col("text"))))
    rows = c.join(images, ["doc_id", "page", "block"]).select("doc_id", "page", "block", text.alias("text")).where("text <> ''")
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "block", "text"))).alias("parts"))
    return g.select("doc_id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n").alias("text"))


def footnotes(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, note, text``: lines of discarded footnote blocks, each note from its mark to the next."""
    lines = blocks.where(~F.col("kept") & is_footnote(F.col("lines"))).select("doc_id", "page", "block", F.posexplode("lines").alias("n", "l"))
    lines = lines.select("doc_id", "page", "block", "n", F.array_join(F.transform("l.spans", span_text), "").alias("text"))
    w = Window.partitionBy("doc_id", "page").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("note", F.sum(F.col("text").rlike(r"^\s*(?:[①-⑳]|\[\d+\]|\(\d+\)|\d+[.、)]|[*†‡])").cast("int")).over(w)).where("note > 0")
    g = marked.groupBy("doc_id", "page", "note").agg(F.array_sort(F.collect_list(F.struct("block", "n", F.trim("text").alias("text")))).alias("parts"))
    return g.select("doc_id", "page", "note", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


def best_text(pages: DataFrame, least: float = 0.75) -> DataFrame:
    """Pages (doc_id, page, raw, markdown): the Markdown where it covers enough of the raw text, else the raw text."""
    from ..functions.similarity import text_coverage

    share = text_coverage("raw", F.coalesce("markdown", F.lit("")))
    return pages.select("doc_id", "page", F.round(share, 6).alias("coverage"), F.when(share < least, F.col("raw")).otherwise(F.col("markdown")).alias("text"))
