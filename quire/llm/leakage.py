"""Problem 8: evaluation items that occur in the corpus.

Prefix-filtered set join on shingles of letters and digits. One scan of the corpus finds the places of shingles that
may be an item's (a bitmap of fixed size rules the others out) and gathers neighbouring places into windows, which
carry their letters. Everything after that runs on the windows: the shingles of the items are counted there and ordered
by rarity. A passage that shares ``need = ceil(SHARED * n)`` of an item's n shingles or more shares at least ``l`` of its rarest
``n - need + l``, its prefix, so prefixes alone are joined with the windows, with l the half of need. A joined place
counts if the letters before and after it on both sides still leave room for HELD of the item. The pairs with l places are verified: matching
blocks are chained in the order of both texts, and the chain must hold HELD of the item's letters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, spread, table
from .ngram import codes, grams, letters

#: Letters of a shingle in scripts that write syllables or words with one character, and in others.
DENSE_GRAM, GRAM = 6, 12
DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿\U00020000-\U0003ffff]")
SHARED = 0.3  # shingles that half an item still shares when one letter in twelve is altered
HELD = 0.5  # letters of the item that a document must hold
GAP = 48  # letters between two blocks of one passage
ITEM_DENSITY, DOC_DENSITY = 0.8, 0.6  # held letters against the stretch of the item, and of the document, that the passage spans
BITS = 24  # bits of a shingle that the bitmap tells apart; it has 2 MB however many items there are
HOT = 1000  # a shingle with more than this part of all places is split; there are fewer than HOT such shingles
ITEM_BYTES = 64 << 20  # letters of all items up to which they are broadcast; beyond, pairs and items meet by a salted join
ITEM_SALTS = 16
PREFIX_ROWS = 1_000_000  # shingles of all items up to which the prefixes are broadcast (some 30 MB); beyond, they meet the places by a salted join

ITEMS = "item_id long, key long, times int, item string, size int, need int, gram array<long>, at array<int>"
WINDOWS = "row long, doc_id long, start int, letters string, gram array<long>, at array<int>"
PAIRS = "doc_id long, item_id long, held double, start_pos int, end_pos int"


def gram_size(text: str) -> int:
    return DENSE_GRAM if 2 * len(DENSE.findall(text)) >= len(text) else GRAM


def shingles(chars: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles from each position on, told apart by their length."""
    with np.errstate(over="ignore"):
        return grams(chars, k) ^ np.uint64(k) * np.uint64(0xD6E8FEB86659FD93)


def bit_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch, 0) & v
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def chain(item: str, doc: str, p: np.ndarray, q: np.ndarray, k: int) -> tuple[int, int, int]:
    """``(held letters, start, end)`` of the best chain; ``p``, ``q``: shingle hits in document and item."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p - q) != 0) | (np.diff(p) > k)
    start = np.nonzero(new)[0]
    end = np.append(start[1:], len(p)) - 1
    # single altered letters leave a diagonal, so hits of one diagonal up to a shingle apart are one block
    blocks = sorted(zip(p[start].tolist(), q[start].tolist(), (p[end] - p[start] + k).tolist()))
    longest = max(n for _, _, n in blocks)
    best: list[tuple[int, int, int]] = []
    for j, (pj, qj, nj) in enumerate(blocks):
        held, came, since = nj, pj, qj
        for i in range(j - 1, -1, -1):
            pi, qi, ni = blocks[i]
            if pi + longest + GAP < pj:
                break  # blocks are in the order of the document, so all others end too early
            gp, gq = pj - pi - ni, qj - qi - ni
            lap = max(0, -gp, -gq)
            if qj > qi and lap < nj and gp <= GAP and gq <= GAP:
                between = 0
                if not lap and 0 < gq and gp <= 3 * k and gq <= 3 * k:
                    between = common_subsequence(item[qi + ni : qj], doc[pi + ni : pj])
                if best[i][0] + nj - lap + between > held:
                    held, came, since = best[i][0] + nj - lap + between, *best[i][1:]
        best.append((held, came, since))

    def dense(j: int) -> bool:
        held, came, since = best[j]
        return held >= ITEM_DENSITY * (blocks[j][1] + blocks[j][2] - since) and held >= DOC_DENSITY * (blocks[j][0] + blocks[j][2] - came)

    top = max(range(len(best)), key=lambda j: (dense(j), best[j][0]))
    return best[top][0] if dense(top) else 0, best[top][1], blocks[top][0] + blocks[top][2]


def items_of(benchmark: DataFrame) -> DataFrame:
    """One row per different item: its letters, shingles with their places, and how many of them a passage must share.

    ``times`` counts repeated rows. Null texts and texts shorter than a shingle are no items.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for item_id, key, times, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = letters(text)
            k = gram_size(text)
            if len(text) >= k:
                h = shingles(codes([text])[0], k)
                need = max(1, int(np.ceil(SHARED * len(np.unique(h)))))
                out.append((item_id, key, times, text, k, need, h.view(np.int64), np.arange(len(h), dtype=np.int32)))
        if not out:
            return None
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in ITEMS.split(", ")])

    given = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    given = given.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("times"))
    return arrow_map(given.select("item_id", F.xxhash64("item_id", "text").alias("key"), "times", "text"), rows, ITEMS)


def bitmap_of(items: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """``(bitmap of the first BITS bits of all shingles, least need of an item, bytes of all items' letters, their shingles)``."""
    least = items.agg(F.min("need"), F.sum(F.octet_length("item")), F.sum(F.size("gram"))).first()
    parts = items.select(F.explode("gram").alias("h")).select((F.shiftrightunsigned("h", 64 - BITS) + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.collect():  # at most 2 ** (BITS - 15) rows of 4 KB
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return bits, *(x or 0 for x in least)


def windows_of(docs: DataFrame, bits: np.ndarray, need: int) -> DataFrame:
    """The stretches of the documents whose places of possible item shingles lie at most GAP letters apart.

    A stretch with fewer than ``need`` different ones can hold no passage and is left out. This is the one scan of the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, doc, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        norm = [letters(t) for t in texts]
        chars, starts = codes(norm)
        bitmap, at, gram = shared.value, [], []
        for k in (DENSE_GRAM, GRAM):
            h = shingles(chars, k)
            s = bit_of(h)
            p = np.nonzero(bitmap[s >> 3] >> (s & 7).astype(np.uint8) & 1)[0]
            p = p[p + k <= starts[np.searchsorted(starts, p, "right")]]
            at.append(p)
            gram.append(h[p])
        at, gram = np.concatenate(at), np.concatenate(gram)
        if not len(at):
            return None
        order = np.lexsort((gram, at))
        at, gram = at[order], gram[order]
        text = np.searchsorted(starts, at, "right") - 1
        first = np.nonzero(np.append(True, (np.diff(text) != 0) | (np.diff(at) > GAP + GRAM)))[0]
        out = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
            if b - a >= need and len(np.unique(gram[a:b])) >= need:
                t = int(text[a])
                low = int(at[a] - starts[t])
                out.append((t, low, norm[t][low : int(at[b - 1] - starts[t]) + GRAM], gram[a:b].view(np.int64), (at[a:b] - at[a]).astype(np.int32)))
        if not out:
            return None
        t, low, passage, g, p = zip(*out)
        take = pa.array(t)
        cols = [row.take(take), doc.take(take), pa.array(low, pa.int32()), pa.array(passage, pa.string()), pa.array(g, pa.list_(pa.int64())), pa.array(p, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in WINDOWS.split(", ")])

    given = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(given, rows, WINDOWS).withColumn("win", F.monotonically_increasing_id())


def fewest(need: Column) -> Column:
    """Places of an item's prefix that a passage must have."""
    return F.ceil(need / 2).cast("int")


def prefixes_of(items: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, gram, q, size, n, l``: of each item the rarest shingles, of which every passage that shares ``need`` has ``l``."""
    each = items.select("key", F.length("item").alias("size"), "need", F.inline(F.arrays_zip("gram", F.col("at").alias("q")))).join(counts, "gram", "left").fillna(0, ["n"])
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("n", "gram"))  # an item has as many rows as letters
    each = each.withColumn("rank", rank).withColumn("distinct", F.max("rank").over(Window.partitionBy("key"))).withColumn("l", fewest(F.col("need")))
    return each.where((F.col("rank") <= F.col("distinct") - F.col("need") + F.col("l")) & (F.col("n") > 0)).select("key", "gram", "q", "size", "n", "l")


def candidates_of(windows: DataFrame, items: DataFrame, places: int, shingles: int = PREFIX_ROWS + 1) -> DataFrame:
    """``win, key``: windows and items that meet on enough prefix shingles with room for HELD of the item around them."""
    counts = windows.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    hits = windows.select("win", F.length("letters").alias("room"), F.inline(F.arrays_zip("gram", F.col("at").alias("p"))))
    prefix = prefixes_of(items, counts)
    if shingles <= PREFIX_ROWS:
        met = hits.join(F.broadcast(prefix), "gram")
    else:
        share = max(1, places // HOT)
        salts = F.ceil(F.col("n") / share).cast("int")
        hot = counts.where(F.col("n") > share).select("gram", salts.alias("salts"))  # fewer than HOT rows, for their places are more than all
        hits = hits.join(F.broadcast(hot), "gram", "left").withColumn("salt", F.pmod(F.xxhash64("win"), F.coalesce("salts", F.lit(1))).cast("int"))
        met = hits.join(prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))), ["gram", "salt"])
    fits = F.least("p", "q") + F.least(F.col("room") - F.col("p"), F.col("size") - F.col("q")) >= HELD * F.col("size")
    met = met.where((F.col("room") >= HELD * F.col("size")) & fits).groupBy("win", "key").agg(F.count("*").alias("places"), F.first("l").alias("l"))
    return met.where("places >= l").select("win", "key")


def verified(pairs: DataFrame) -> DataFrame:
    """The best chain of every pair of a window and an item that holds HELD of the item."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}

        def array(name: str, n: int) -> np.ndarray:
            low, high = c[name].offsets[n].as_py(), c[name].offsets[n + 1].as_py()
            return values[name][low:high]

        values = {x: c[x].values.to_numpy() for x in ("gram", "at", "item_gram", "item_at")}
        keep, out, known = [], [], {}
        for n in range(batch.num_rows):
            key = c["key"][n].as_py()
            if key not in known:
                h = array("item_gram", n)
                order = np.argsort(h, kind="stable")
                known[key] = c["item"][n].as_py(), h[order], array("item_at", n)[order].astype(np.int64)
            item, h, q = known[key]
            w, p = array("gram", n), array("at", n).astype(np.int64)
            low = np.searchsorted(h, w)
            many = np.searchsorted(h, w, "right") - low
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            if len(np.unique(h[at])) < c["need"][n].as_py():
                continue
            held, a, b = chain(item, c["letters"][n].as_py(), np.repeat(p, many), q[at], c["size"][n].as_py())
            if held >= HELD * len(item):
                keep.append(n)
                out.append((min(1.0, held / len(item)), a + c["start"][n].as_py(), b + c["start"][n].as_py()))
        if not keep:
            return None
        take, cols = pa.array(keep), [pa.array(x, t) for x, t in zip(zip(*out), (pa.float64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*(c[x].take(take) for x in ("row", "key", "doc_id", "item_id", "times")), *cols], ["row", "key", "doc_id", "item_id", "times", "held", "start_pos", "end_pos"])

    return arrow_map(pairs, rows, "row long, key long, doc_id long, item_id long, times int, held double, start_pos int, end_pos int")


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, held, start_pos, end_pos``: every document and item of which it holds half or more.

    Offsets count the letters and digits of the document, of the best passage. Null texts and texts without a shingle
    match nothing; repeated rows of either side match each for itself. The corpus is read once however many items
    there are: its windows are cut by a checkpoint, and counts, join and verification read those.
    """
    docs = docs.select("doc_id", F.col(text_col).alias("text"))
    items = cut(items_of(benchmark.select("item_id", "text")))
    bits, need, size, shingles = bitmap_of(items)
    windows = cut(windows_of(docs, bits, max(1, need)))
    places = windows.agg(F.sum(F.size("gram"))).first()[0] or 0
    pairs = candidates_of(windows, items, places, shingles).join(windows, "win")
    asked = items.select("key", "item_id", "times", "item", "size", "need", F.col("gram").alias("item_gram"), F.col("at").alias("item_at"))
    if size <= ITEM_BYTES:
        pairs = pairs.join(F.broadcast(asked), "key")
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ITEM_SALTS - 1))))
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("win"), F.lit(ITEM_SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    best = verified(pairs).groupBy("row", "key").agg(F.max_by(F.struct("doc_id", "item_id", "times", "held", "start_pos", "end_pos"), F.struct("held", -F.col("start_pos"))).alias("b"))
    best = best.select("b.*").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return best.select("doc_id", "item_id", "held", "start_pos", "end_pos")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "item_id")
