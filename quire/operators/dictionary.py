"""Dictionary tables: merging, filling, extraction from tagged entries, compact forms and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_map(rows: DataFrame, key: str = "k", value: str = "v", seen: str = "seen", glue: str = "；") -> DataFrame:
    """``key, merged``: the distinct values of a key in the order first seen. Values are counted once before they are gathered."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(seen).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), glue).alias("merged"))


def fill_down(rows: DataFrame, order: list[str], column: str, salts: int = 64) -> DataFrame:
    """Nulls of a column take the last value before them in the order.

    The order is over the whole table, so it is cut into ranges: each range fills itself, and ranges that begin with
    nulls take the last value of those before, which is one row a range.
    """
    ranged = rows.repartitionByRange(salts, *order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("_own", F.last(column, ignorenulls=True).over(w))
    lasts = filled.groupBy("_part").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return filled.join(F.broadcast(carried), "_part").withColumn(column, F.coalesce("_own", "_carried")).select(*rows.columns)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated, so that no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*key, "_row.*")


def entries(content: Column, tag: str) -> Column:
    """The blocks of one tag in their order."""
    return F.regexp_extract_all(content, F.lit(f"(?s)<{tag}\\b.*?</{tag}>"), F.lit(0))


def plain(content: Column) -> Column:
    return F.regexp_replace(content, "<[^>]+>", "")


def life_dates(content: Column) -> Column:
    """``array<struct<name, dates>>`` of ``name（year—year）`` in running text."""
    whole = F.regexp_extract_all(content, F.lit(r"[\x{4e00}-\x{9fff}·]{2,12}（[约前公元？?\d\s]*\d[^（）]{0,20}[—–-][^（）]{0,20}）"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, "^([^（]+)（", 1).alias("name"), F.regexp_extract(x, "（([^）]*)）", 1).alias("dates")))


def fuzzy_year(c: Column) -> Column:
    """A dated year as ``struct<approx, bce, year, uncertain>``: ``约前369`` is about 369 BCE, ``701？`` uncertain."""
    return F.struct(c.contains("约").alias("approx"), c.contains("前").alias("bce"), F.regexp_extract(c, r"(\d+)", 1).try_cast("int").alias("year"), c.rlike("[？?]").alias("uncertain"))


def split_variants(c: Column) -> Column:
    """The variants of a list joined by ``、``, trimmed, without asterisks and empty ones."""
    return F.filter(F.transform(F.split(c, "、"), lambda x: F.trim(F.replace(x, F.lit("*"), F.lit("")))), lambda x: x != "")


def reverse_map(rows: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """``variant, standards``: the keys of each of a key's variants; several keys are a conflict and all kept."""
    each = rows.select(F.explode(split_variants(F.col(value))).alias("variant"), F.col(key).alias("standard")).distinct()
    return each.groupBy("variant").agg(F.array_sort(F.collect_list("standard")).alias("standards"))


def compact(rows: DataFrame, key: str = "head") -> DataFrame:
    """One JSON value a head: a bare string for a single unlabelled record, else the list of records (label, raw)."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", "raw"))).alias("records"))
    single = (F.size("records") == 1) & F.col("records")[0]["label"].isNull()
    return g.select(key, F.when(single, F.to_json(F.array(F.col("records")[0]["raw"]))).otherwise(F.to_json("records")).alias("value"), single.alias("bare"))


def expand(packed: DataFrame, key: str = "head") -> DataFrame:
    """The records of ``compact`` again."""
    bare = packed.where("bare").select(key, F.lit(None).cast("string").alias("label"), F.from_json("value", "array<string>")[0].alias("raw"))
    rest = packed.where("not bare").select(key, F.inline(F.from_json("value", "array<struct<label:string,raw:string>>")))
    return bare.unionByName(rest)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def extend(base: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """The base rows, and the extra rows whose key the base lacks, each key once."""
    return base.unionByName(extra.dropDuplicates(key).join(base.select(*key), key, "left_anti").select(*base.columns))


def tables_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named map columns of a compact dictionary, and nothing else; a missing or null one is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return rows.select(*((F.coalesce(F.col(n), empty) if n in rows.columns else empty).alias(n) for n in names))


def distribution(source: DataFrame, buckets: list[str], extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The compact form of the records (bucket, head, label, raw) of some buckets, with those of ``extra`` whose head is missing; and how its expansion differs from them, which must be nothing."""
    kept = source.where(F.col("bucket").isin(buckets)).select("head", "label", "raw").distinct()
    if extra is not None:
        kept = kept.unionByName(extra.select("head", "label", "raw").distinct().join(kept.select("head").distinct(), "head", "left_anti"))
    packed = compact(kept)
    return packed, differences(expand(packed), kept)
