"""Word models: n-gram counts, document frequencies, bigram retention, and a shallow decision tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as T


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, word``: the pieces between blanks and line ends."""
    parts = F.filter(F.split(F.col(text), r"[ \n]+"), lambda x: x != "")
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "word"))


def document_frequency(w: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headwords with the number of documents that have them; each document counts once before the shuffle by word."""
    return w.where(T.is_headword(F.col("word"))).select(key, "word").distinct().groupBy(F.col("word").alias("headword")).agg(F.count("*").alias("documents"))


def bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, w1, w2``: each word with the one after it, paired within the text's row."""
    parts = F.filter(F.split(F.col(text), r"[ \n]+"), lambda x: x != "")
    w = docs.where(F.col(text).isNotNull()).select(key, parts.alias("w")).where(F.size("w") > 1)
    both = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("w1"), F.slice("w", 2, F.size("w") - 1).alias("w2"))
    return w.select(key, F.inline(both))


def bigram_model(pairs: DataFrame) -> DataFrame:
    """``w1, w2, n, probability`` over all documents' bigrams; the total is one row and joined as such."""
    n = pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("w1", "w2", "n", (F.col("n") / F.col("total")).alias("probability"))


def rare_bigrams(pairs: DataFrame, below: float, key: str = "doc_id") -> DataFrame:
    """Documents with the number of their bigrams of a probability under ``below``."""
    each = pairs.groupBy(key, "w1", "w2").agg(F.count("*").alias("here"))
    return each.join(bigram_model(pairs).where(F.col("probability") < below), ["w1", "w2"]).groupBy(key).agg(F.sum("here").alias("rare_bigrams"))


def retention(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, retention``: the share of a's bigrams, as a multiset, that b keeps; texts without a bigram are left out."""
    return pairs.where(F.length(a) >= 2).select(key, F.round(similarity.bigram_retention(F.col(a), F.col(b)), 3).alias("retention"))


def tree_classes(texts: DataFrame, depth: int = 5, least: int = 5) -> DataFrame:
    """``id, label, prediction`` of a decision tree on the text features, fitted on the labels (0 or 1) of the texts (id, text, label)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    f = T.features(F.col("text"))
    rows = texts.where("text is not null").select("id", *(c.cast("double").alias(k) for k, c in f.items()), F.col("label").cast("double").alias("label"))
    data = VectorAssembler(inputCols=list(f), outputCol="features").transform(rows)
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, seed=1).fit(data)
    return tree.transform(data).select("id", "label", "prediction")
