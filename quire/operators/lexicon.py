"""Checks against character and word lexicons.

A lexicon is a table. Occurrences of its words are found by an automaton where it is small, and else by joining the
places where a word may begin with the words on a hash; both are one scan of the texts and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rolling
from ..functions import text as T

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


HAN_RANGE = (0x4E00, 0x9FFF)


def characters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, ch`` of the Han characters of each text, 0-based."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(T.characters(F.col(text))).alias("pos", "ch")).where(T.is_han(F.col("ch")))


def character_findings(docs: DataFrame, forms: DataFrame, standard: DataFrame, notes: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, ch, kind, suggestion`` of the characters that are traditional, variants, or not in the standard.

    ``forms``: (ch, kind, standard_ch), kind ``traditional`` or ``variant``; forms mapped to themselves are none. A
    character of both kinds gives two rows. ``standard``: (ch). ``notes``: (ch, note), added in brackets.

    Forms and standard make one verdict for each character, which Unicode bounds at some 21,000 Han ones; it goes to the
    workers as an array by code point, so a text is looked up at once and only findings become rows.
    """
    mapped = forms.groupBy("ch", "kind").agg(F.array_join(F.array_sort(F.collect_set("standard_ch")), "").alias("suggestion")).where("suggestion <> ch")
    if notes is not None:
        n = notes.groupBy("ch").agg(F.min("note").alias("note"))
        mapped = mapped.join(n, "ch", "left").withColumn("suggestion", F.concat("suggestion", F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("("), F.col("note"), F.lit(")"))).otherwise(""))).drop("note")
    verdicts = mapped.groupBy("ch").agg(F.collect_list(F.struct("kind", "suggestion")).alias("verdicts"))
    known = verdicts.join(standard.where(F.length("ch") == 1).select("ch").distinct(), "ch", "full").where(T.is_han(F.col("ch")))
    said = {r["ch"]: [tuple(v) for v in r["verdicts"] or ()] for r in known.collect()}  # one row a Han character
    low, high = HAN_RANGE
    flagged = np.array([bool(said.get(chr(c), (("not_in_standard", ""),))) for c in range(low, high + 1)])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            chars, starts = rolling.codes(texts)
            han = np.nonzero((chars >= low) & (chars <= high))[0]
            hit = han[flagged[chars[han] - low]]
            owner = np.searchsorted(starts, hit, "right") - 1
            rows = [(k, p, ch, *v) for k, p, c in zip(owner.tolist(), (hit - starts[owner]).tolist(), chars[hit].tolist()) for ch in (chr(c),) for v in said.get(ch, (("not_in_standard", ""),))]
            at, pos, ch, kinds, suggestions = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *(pa.array(x, pa.string()) for x in (ch, kinds, suggestions))], [key, "pos", "ch", "kind", "suggestion"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, pos int, ch string, kind string, suggestion string")


#: Words up to which a lexicon becomes an automaton on every worker; larger ones are joined.
AUTOMATON_WORDS = 200_000


def word_findings(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_pos, end_pos, word, suggestion`` of every occurrence of the lexicon's words, overlapping ones too.

    ``lexicon``: (word, standard). A lexicon of at most AUTOMATON_WORDS, which is counted, is searched for by one
    automaton in one pass over the texts; a larger one, or one where there is no automaton, by a join.
    """
    words = lexicon.where(F.length("word") > 0)
    if ahocorasick is not None:
        known = words.limit(AUTOMATON_WORDS + 1).collect()
        if len(known) <= AUTOMATON_WORDS:
            return _by_automaton(docs, [(r["word"], r["standard"]) for r in known], key, text)
    return _by_join(docs, words, key, text)


FINDING = "start_pos int, end_pos int, word string, suggestion string"


def _by_automaton(docs: DataFrame, words: list[tuple[str, str]], key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    if not words:
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, {FINDING}")

    def run(batches):
        machine, standards = ahocorasick.Automaton(), {}
        for word, standard in words:
            standards.setdefault(word, []).append(standard)
            machine.add_word(word, word)
        machine.make_automaton()
        for batch in batches:
            at, starts, ends, found, said = [], [], [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                for last, word in machine.iter(body or ""):
                    for standard in standards[word]:
                        at.append(k)
                        starts.append(last + 1 - len(word))
                        ends.append(last + 1)
                        found.append(word)
                        said.append(standard)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string()), pa.array(said, pa.string())], [key, "start_pos", "end_pos", "word", "suggestion"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {FINDING}")


def _by_join(docs: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """One scan of the texts for words of all lengths.

    A word goes by the hash of the longest run of a power of two of characters that it begins with. A bitmap of fixed size of
    those hashes gives the places of the texts where a word may stand; these meet the words on the hash, where the whole word is compared.
    """
    words = lexicon.select("word", F.col("standard").alias("suggestion"))
    kind = docs.schema[key].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [1 << len(w).bit_length() - 1 for w in batch.column(0).to_pylist()]
            h = [rolling.runs(rolling.codes([w[:k]])[0], [k])[k][0] for w, k in zip(batch.column(0).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], ["word", "suggestion", "n", "h"])

    k = words.mapInArrow(anchors, "word string, suggestion string, n int, h long")
    sizes = sorted(r[0] for r in words.select(rolling.power(F.length("word"))).distinct().collect())  # powers of two
    shared = docs.sparkSession.sparkContext.broadcast((rolling.bitmap(k, "h"), sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            at, pos, hashes, seen = [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                for n, h in rolling.runs(rolling.codes([body or ""])[0], sizes).items():
                    for p in rolling.maybe(bits, h).tolist():
                        at.append(row)
                        pos.append(p)
                        hashes.append(h[p])
                        seen.append(body[p : p + 2 * n])  # a word with this run has fewer than twice its characters
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(seen, pa.string())], [key, "start_pos", "h", "seen"])

    places = docs.select(key, text).mapInArrow(scan, f"{key} {kind}, start_pos int, h long, seen string").withColumn("salt", F.pmod(F.xxhash64(key, "start_pos"), F.lit(SALTS)).cast("int"))
    salted = k.select("word", "suggestion", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = places.join(salted, ["h", "salt"]).where(F.startswith("seen", "word"))
    return met.select(key, "start_pos", (F.col("start_pos") + F.length("word")).cast("int").alias("end_pos"), "word", "suggestion")


SALTS = 8  # parts of the places of a frequent word


def first_occurrences(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first occurrence of each word in each text."""
    return found.groupBy(key, "word", "suggestion").agg(F.min("start_pos").alias("start_pos"))


def resolve_overlaps(spans: DataFrame, key: str = "doc_id", priority: str | None = None) -> DataFrame:
    """Keeps the best span of each run of overlapping spans: ``kept`` tells.

    A run is a chain of spans each of which starts before the furthest end so far. The best has the highest
    priority, then the greatest length, then the first start.
    """
    order = Window.partitionBy(key).orderBy("start_pos", "end_pos", "word")
    far = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", F.when(far.isNull() | (F.col("start_pos") >= far), 1).otherwise(0)).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    best = Window.partitionBy(key, "run").orderBy(*([F.desc(priority)] if priority else []), F.desc(F.col("end_pos") - F.col("start_pos")), "start_pos", "word")
    return runs.withColumn("kept", F.row_number().over(best) == 1).drop("_new")


def severity(kind):
    """Column: how serious a finding of a kind is."""
    return F.when(kind == "not_in_standard", "info").when(kind.isin("traditional", "variant"), "error").otherwise("warn")
