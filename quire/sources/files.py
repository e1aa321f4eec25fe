"""Text files, manifests with their hashes, findings and lexicons in JSON, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "array<struct<phase:string,original:string,suggested:string,location:string,fix_class:string,severity:string,reason:string>>"


def manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, sha256, length, modified`` of the files under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose hash is not what it was, with both hashes; a missing side is null."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("now")))


def accepted(claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (source_sha256, ...) split by whether a source (sha256) has that hash."""
    known = sources.select(F.col("sha256").alias("source_sha256")).distinct()
    return claims.join(known, "source_sha256", "left_semi"), claims.join(known, "source_sha256", "left_anti")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of JSON files: a list, an object of lists by phase, or an object with a list ``findings``.

    ``path, phase, original, suggested, location, fix_class, severity, reason``; other keys of the same sense count.
    Rows without any of the texts are left out.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    row = "array<map<string,string>>"
    listed = raw.where(F.trim("value").startswith("[")).select("path", F.lit(None).cast("string").alias("key"), F.explode(F.from_json("value", row)).alias("m"))
    keyed = raw.where(F.trim("value").startswith("{")).select("path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "body")).where(F.trim("body").startswith("["))
    keyed = keyed.select("path", F.when(F.col("key") != "findings", F.col("key")).alias("key"), F.explode(F.from_json("body", row)).alias("m"))

    def first(*names: str):
        return F.coalesce(*(F.when(F.trim(F.col("m")[n]) != "", F.col("m")[n]) for n in names))

    f = listed.unionByName(keyed).select(
        "path",
        F.coalesce(first("phase"), F.col("key")).alias("phase"),
        first("current", "original_sentence", "original", "char", "wrong", "text").alias("original"),
        first("suggested", "corrected_sentence", "suggestion", "correct", "replace", "message").alias("suggested"),
        *(first(n).alias(n) for n in ("location", "fix_class", "severity")),
        first("reason", "message").alias("reason"),
    )
    return f.where("original is not null or suggested is not null")


def validated(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues split into sound ones and rejects with the first rule that each breaks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rule = (
        F.when(blank("original"), "original_missing")
        .when(blank("location"), "location_missing")
        .when(~F.coalesce(F.col("fix_class"), F.lit("")).isin("must_fix", "polish", "verify"), "fix_class_unknown")
        .when(~F.col("location").rlike(r"^P\d+$|^\d+(?:-\d+)?$"), "location_unreadable")
        .when((F.col("fix_class") == "must_fix") & blank("suggested"), "suggestion_missing")
    )
    checked = issues.withColumn("rule", rule)
    return checked.where("rule is null").drop("rule"), checked.where("rule is not null")


def lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """``word, standard`` of JSON objects of words; a later file's word replaces an earlier one's."""
    parts = None
    for n, path in enumerate(paths):
        m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "standard"), F.lit(n).alias("n"))
        parts = m if parts is None else parts.unionByName(m)
    return parts.groupBy("word").agg(F.max_by("standard", "n").alias("standard"))


def refined(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks (key, chunk_idx, target) joined to one text each, in order."""
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "target"))).alias("parts"))
    return g.select(key, F.array_join(F.transform("parts", lambda x: F.coalesce(x["target"], F.lit(""))), "\n").alias("text"))


def write_findings(rows: DataFrame, path: str, source: str | None = None) -> None:
    """JSON lines by phase. A folder is committed as a whole; one that holds the source is refused."""
    if source and (source == path or source.startswith(path.rstrip("/") + "/")):
        raise ValueError(f"{path} holds the source {source}")
    rows.write.mode("overwrite").partitionBy("phase").json(path)


def write_skipped(rows: DataFrame, path: str) -> None:
    """Skipped findings (reason, ...) as JSON lines under ``path/rows``, by reason, and their counts under ``path/counts``."""
    rows.write.mode("overwrite").partitionBy("reason").json(f"{path}/rows")
    rows.groupBy("reason").agg(F.count("*").alias("skipped")).coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def write_special(rows: DataFrame, path: str) -> None:
    """Findings of the special checks as CSV of five columns without quotes; the first file holds the header with a byte order mark, so that the files put together are read as UTF-8."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[,\\r\\n]+", " ")
    cols = ["type", "original", "suggestion", "start_pos", "severity"]
    line = F.concat_ws(",", *(clean(c) for c in cols))
    head = rows.sparkSession.createDataFrame([("\ufeff" + ",".join(cols),)], "value string").withColumn("part", F.lit(0))
    parts = head.unionByName(rows.select(line.alias("value"), F.lit(1).alias("part"))).repartitionByRange("part")
    parts.sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def source_of(findings_path: str, paths: list[str]) -> str | None:
    """The document of the same stem beside a file of findings; of several the shortest name, then the first."""
    folder, _, name = findings_path.rpartition("/")
    stem = name.rsplit(".", 1)[0]
    same = [p for p in paths if p.rpartition("/")[0] == folder and p.lower().endswith(".docx") and stem.startswith(p.rpartition("/")[2][:-5]) and p.rpartition("/")[2][:-5]]
    exact = [p for p in same if p.rpartition("/")[2][:-5] == stem]
    return min(exact or same, key=lambda p: (len(p), p), default=None)


def review_source(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256, pos, text, error`` of every file of a folder by its kind: Word documents by paragraphs, Markdown by lines.

    A file of another kind, one that can't be read, and one without any text give one row with an ``error``.
    """
    from . import docx

    plain = F.regexp_replace("path", "^file:/+", "file:/")  # readers write local paths in two ways
    m = manifest(spark, folder).select(plain.alias("path"), "sha256")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    word = docx.read(spark, folder).select(plain.alias("path"), "pos", "text", F.when(F.col("kind") == "error", F.col("text")).alias("error"))
    lines = texts(spark, folder).select(plain.alias("path"), F.posexplode(F.split("text", "\r\n?|\n")).alias("pos", "text")).withColumn("error", F.lit(None).cast("string"))
    units = word.unionByName(lines)
    full = units.groupBy("path").agg(F.max((F.trim(F.coalesce("text", F.lit(""))) != "").cast("int")).alias("full"))
    j = m.join(full, "path", "left")
    bad = j.where(~kind.isin("docx", "md") | F.coalesce("full", F.lit(0)).eqNullSafe(0)).select("path", "sha256", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("text"), F.when(kind.isin("docx", "md"), "no_text").otherwise("unsupported").alias("error"))
    good = units.join(j.where("full = 1").select("path", "sha256"), "path").select("path", "sha256", "pos", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
    return good.unionByName(bad)
