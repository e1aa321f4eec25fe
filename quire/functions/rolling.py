"""Hashes of all runs of a power of two of characters, and bitmaps of a fixed size that rule most of them out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = np.uint64(0xA24BAED4963EE407)
BITS = 26  # bits of a hash that a bitmap tells apart: 8 MB however many hashes there are
SECOND = 20  # bits by which the second slot of a hash begins further down


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and where each text starts (and one more)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(chars: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Of each size, a power of two, the hashes of the runs from every position that has one."""
    out: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        h, span, shift = chars.astype(np.uint64) + np.uint64(7), 1, STEP
        while True:
            if span in sizes:
                out[span] = mixed(h + np.uint64(span))
            if span >= max(sizes, default=0) or len(h) <= span:
                break
            h, span, shift = h[:-span] * shift + h[span:], span * 2, shift * shift
    return out


def power(length: Column) -> Column:
    """The greatest power of two that is no more than a length of 1 or more."""
    return F.pow(F.lit(2), F.length(F.bin(length)) - 1).cast("int")


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Two slots of BITS bits of every hash, marked; at most 2 ** (BITS - 15) rows of 4 KB come to the driver."""
    h = F.col(column)
    slots = F.array(F.shiftrightunsigned(h, 64 - BITS), F.shiftrightunsigned(h, 64 - BITS - SECOND).bitwiseAND((1 << BITS) - 1))
    each = hashes.where(h.isNotNull()).select(F.explode(slots).alias("slot")).select((F.col("slot") + 1).alias("s"))
    parts = each.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.collect():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return bits


def maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that a bitmap doesn't rule out."""
    at = np.nonzero(_marked(bits, h >> np.uint64(64 - BITS)))[0]
    return at[_marked(bits, h[at] >> np.uint64(64 - BITS - SECOND) & np.uint64((1 << BITS) - 1))]


def _marked(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    s = slot.astype(np.int64)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
