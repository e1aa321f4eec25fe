"""Similarity of texts by Arrow functions: subsequence ratios, window search, edit spans, multiset overlap."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine word operation a character of ``b`` and word of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        hit = v & where.get(ch, 0)
        v = (v + hit | v - hit) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100; two empty texts are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_match(text: str, fragment: str, slack: int = 3) -> tuple[str, int, float] | None:
    """The window of the text most like the fragment: ``(window, position, ratio)``.

    Windows have 2 characters at least and differ from the fragment's length by under ``slack``. The first of equal
    windows wins, unless a later one starts like the fragment and it does not. A contained fragment of two
    characters or more is found without a search.
    """
    n = len(fragment)
    if not fragment or not text:
        return None
    if n >= 2 and (at := text.find(fragment)) >= 0:
        return fragment, at, 100.0
    low, high = max(2, n - slack), min(n + slack - 1, len(text))
    if low > high:
        return None
    return _grown_windows(text, fragment, low, high)


def _grown_windows(text: str, fragment: str, low: int, high: int) -> tuple[str, int, float] | None:
    """The best window by bit-parallel common subsequences, the windows from all starts grown side by side.

    A state is one word for each 64 characters of the fragment; additions carry from word to word.
    """
    n, starts = len(fragment), len(text) - low + 1
    words = -(-n // 64)
    where: dict[str, int] = {}
    for i, ch in enumerate(fragment):
        where[ch] = where.get(ch, 0) | 1 << i
    part = (1 << 64) - 1
    letters = [where.get(ch, 0) for ch in text]
    rows = np.zeros((words, len(text) + high), np.uint64)
    for w in range(words):
        rows[w, : len(text)] = [x >> 64 * w & part for x in letters]
    full = [np.uint64(((1 << n) - 1) >> 64 * w & part) for w in range(words)]
    v = [np.full(starts, f, np.uint64) for f in full]
    like = np.fromiter((ch == fragment[0] for ch in text[:starts]), bool, starts)
    best: tuple[float, bool, int, int] | None = None  # ratio, starts like the fragment, -size, -start
    for size in range(1, high + 1):
        carry = None
        for w in range(words):
            hit = v[w] & rows[w, size - 1 : size - 1 + starts]
            total = v[w] + hit
            over = total < hit
            if carry is not None:
                total += carry
                over |= total < carry
            v[w] = (total | v[w] & ~hit) & full[w]
            carry = over.astype(np.uint64)
        if size >= low:
            have = starts - (size - low)  # windows of this size that the text holds
            shared = n - sum(np.bitwise_count(x[:have]).astype(np.int64) for x in v)
            top = int(shared.max())
            r = 200.0 * top / (size + n)
            if best is None or r >= best[0]:
                at = np.nonzero(shared == top)[0]
                good = at[like[at]]
                first = int(good[0] if len(good) else at[0])
                best = max(best or (-1.0, False, 0, 0), (r, bool(len(good)), -size, -first))
    if best is None:
        return None
    r, _, size, at = best
    return text[-at : -at - size], -at, r


def windows_of_length(text: str, fragment: str) -> tuple[str, int, float] | None:
    """The best window of just the fragment's length: ``(window, position, ratio)``."""
    if (at := text.find(fragment)) >= 0:
        return fragment, at, 100.0
    return _grown_windows(text, fragment, len(fragment), len(fragment)) if len(text) >= len(fragment) else None


def common_substring(a: str, b: str) -> str:
    """The first longest common substring."""
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    return a[m.a : m.a + m.size]


def partial_ratio(short: str, text: str) -> tuple[float, int, int]:
    """The best indel ratio of the shorter text against a window of its length, with the window's span."""
    n = len(short)
    if n == 0 or not text:
        return 0.0, 0, 0
    if n > len(text):
        return partial_ratio(text, short)
    if (at := text.find(short)) >= 0:
        return 100.0, at, at + n
    best = (0.0, 0, 0)
    for at in range(1 - n, len(text)):
        low, high = max(0, at), min(len(text), at + n)
        bound = 200.0 * min(high - low, n) / (high - low + n)
        if bound > best[0] and (r := ratio(short, text[low:high])) > best[0]:
            best = (r, low, high)
    return best


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Edit spans from a to b: equal, insert, delete, replace."""
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def coverage(raw: str, shown: str) -> float:
    """Share of the raw text's letters, blanks aside, that come in the shown text in matching blocks."""
    x, y = "".join(raw.split()), "".join(shown.split())
    return sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / len(x) if x else 1.0


def kept_bigrams(a: str, b: str) -> float | None:
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    total = x.total()
    return (x & y).total() / total if total else None


def _pairwise(function, kind: pa.DataType):
    """Arrow function of two string columns; null where either is null."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return run


@arrow_udf(T.DoubleType())
def lcs_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(ratio, pa.float64())(a, b)


@arrow_udf(T.DoubleType())
def bigram_retention(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(kept_bigrams, pa.float64())(a, b)


@arrow_udf(T.StringType())
def longest_common_substring(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(common_substring, pa.string())(a, b)


@arrow_udf(T.DoubleType())
def text_coverage(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(coverage, pa.float64())(a, b)


@arrow_udf(T.StructType([T.StructField("found", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
def best_window(text: pa.Array, fragment: pa.Array) -> pa.Array:
    kind = pa.struct([("found", pa.string()), ("position", pa.int32()), ("ratio", pa.float64())])
    return _pairwise(lambda t, f: dict(zip(("found", "position", "ratio"), m)) if (m := best_match(t, f)) else None, kind)(text, fragment)


@arrow_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in ("a1", "a2", "b1", "b2"))])))
def edit_spans(a: pa.Array, b: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("tag", pa.string()), *((k, pa.int32()) for k in ("a1", "a2", "b1", "b2"))]))
    return _pairwise(lambda x, y: [dict(zip(("tag", "a1", "a2", "b1", "b2"), o)) for o in opcodes(x, y)], kind)(a, b)
