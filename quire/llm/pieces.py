"""Problem 3: oversized items cut into pieces at natural boundaries.

Content-defined chunking. A polynomial hash rolls over the letters; positions whose hash has its low
bits zero are landmarks, which depend on the last few characters alone. Each landmark snaps to the best
natural boundary near it, which depends on its surroundings alone. A piece ends at the first snapped
landmark between its minimum and maximum size, so after an edit the cuts fall back into step at the
next landmark that both versions reach and only neighbouring pieces change.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, spread, table

WINDOW = 16  # characters that decide a landmark
BASE = np.uint64(0x9E3779B97F4A7C15)
SNAP = 40  # characters around a landmark in which a boundary is sought

#: Natural boundaries, best first; a cut falls after the match.
BOUNDARIES = [
    re.compile(r"(?:\r\n?|\n)[ \t　]*(?:\r\n?|\n)\s*"),
    re.compile(r"\r\n?|\n"),
    re.compile(r"[。！？!?…।]+[”’」』）)\]】»\"']*|\.(?:[”’)\]»\"']*)(?=\s)"),
    re.compile(r"[；;：:，,、](?:\s|(?<=[；：，、]))"),
    re.compile(r"\s+"),
]

PIECES = "chunk_id long, field string, piece int, pieces int, start_pos int, end_pos int, text string"


def boundary_ranks(text: str) -> np.ndarray:
    """Rank of the boundary at each position 0..len (0 none, 5 best)."""
    ranks = np.zeros(len(text) + 1, np.int8)
    for k, pattern in enumerate(reversed(BOUNDARIES), 1):
        ends = [m.end() for m in pattern.finditer(text)]
        if ends:
            ranks[ends] = k
    ranks[0] = 0
    return ranks


def landmarks(text: str, mean: int) -> np.ndarray:
    """Positions after which the hash of the last WINDOW characters has its low bits zero."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    h, span, shift = codes.copy(), 1, BASE
    with np.errstate(over="ignore"):
        while span < WINDOW:  # a hash of 2n characters from two of n
            h = h[:-span] * shift + h[span:]
            shift, span = shift * shift, span * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    bits = max(3, int(np.log2(max(8, mean))))
    return np.nonzero(h & np.uint64((1 << bits) - 1) == 0)[0] + WINDOW


def splits_cluster(text: str, at: int) -> bool:
    """Whether a cut would part a base from its mark, or a line end in two."""
    import unicodedata

    return 0 < at < len(text) and (unicodedata.combining(text[at]) > 0 or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d" or text[at - 1 : at + 1] == "\r\n")


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``[start, end)`` of the pieces of at most ``limit`` characters.

    Each piece starts ``overlap`` characters before the end of the one before it; an overlap that leaves no new character to a
    piece is cut down to one below the limit. A text within the limit is one piece.
    """
    n = len(text)
    limit = max(1, limit)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    step = limit - overlap  # new characters a piece can hold after the first
    least = max(1, step // 3)
    ranks = boundary_ranks(text)
    snapped = set()
    for at in landmarks(text, step // 4):
        low, high = max(1, at - SNAP), min(n - 1, at + SNAP)
        if low <= high and (best := ranks[low : high + 1]).any():
            near = np.nonzero(best == best.max())[0] + low
            snapped.add(int(near[np.argmin(np.abs(near - at))]))
    cuts = np.array(sorted(snapped), np.int64)
    pieces, done, start = [], 0, 0
    while n - start > limit:
        low, high = max(done + least, start + overlap + 1), start + limit
        ahead = cuts[np.searchsorted(cuts, low) : np.searchsorted(cuts, high, "right")]
        if len(ahead):
            end = int(ahead[0])
        elif (window := ranks[low : high + 1]).any():
            end = low + int(np.nonzero(window == window.max())[0][-1])
        else:
            end = high
            while end > low and splits_cluster(text, end):
                end -= 1
        pieces.append((start, end))
        done, start = end, max(end - overlap, start + 1)
    pieces.append((start, n))
    return pieces


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = [[] for _ in range(7)]
    for chunk, field, text, limit, pad in zip(*(c.to_pylist() for c in batch.columns)):
        spans = cut(text, limit, pad)
        for k, (a, b) in enumerate(spans):
            for col, v in zip(cols, (chunk, field, k, len(spans), a, b, text[a:b])):
                col.append(v)
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["chunk_id", "field", "piece", "pieces", "start_pos", "end_pos", "text"])


def pieces(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Pieces of every ``target`` and ``context`` that is longer than its profile allows.

    ``chunks``: chunk_id, profile, target, context; ``settings``: profile, cut_by, context_pad, max_context
    (one row per profile). Returns ``chunk_id, field, piece, pieces, start_pos, end_pos, text`` with half-open
    character offsets into the stored field. Null texts, chunks of a null or unknown profile and null limits
    yield nothing; a null pad is 0; limits below 1 are 1. Repeated rows are cut each for itself.

    Items within the limit never leave the JVM; the settings side is joined as it is, so that Spark broadcasts
    it only while it is as small as its threshold.
    """
    s = settings.select("profile", "cut_by", F.coalesce("context_pad", F.lit(0)).alias("pad"), "max_context").dropDuplicates(["profile"])
    fields = F.array(
        F.struct(F.lit("target").alias("field"), F.col("target").alias("text"), F.col("cut_by").alias("limit")),
        F.struct(F.lit("context").alias("field"), F.col("context").alias("text"), F.col("max_context").alias("limit")),
    )
    over = chunks.select("chunk_id", "profile", "target", "context").where(F.col("target").isNotNull() | F.col("context").isNotNull()).join(s, "profile")
    over = over.select("chunk_id", "pad", F.inline(F.filter(fields, lambda f: F.length(f["text"]) > f["limit"])))
    return arrow_map(over.select(F.col("chunk_id").cast("long"), "field", "text", F.col("limit").cast("int"), F.col("pad").cast("int")), _pieces, PIECES)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spread(table(spark, sf_dir, "your_markdown", "chunk_id", "profile", "target", "context")), table(spark, sf_dir, "split_settings"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that came out in more than one piece."""
    return assembled(spark, sf_dir).where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("chunk_id", "field")
