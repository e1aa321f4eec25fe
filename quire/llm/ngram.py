"""Hashes of all character n-grams of a batch of texts at once."""

from __future__ import annotations

import re

import numpy as np

#: Everything but letters and digits (``\\w`` without the underscore).
NOT_ALNUM = re.compile(r"[\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> str:
    """Letters and digits of a text, case aside; the length is the number of them."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(ch if len(x := ch.lower()) != 1 else x for ch in text)
    return NOT_ALNUM.sub("", low)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts as numbers, and the start of each text (one more at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters from each position on (the last ``n - 1`` positions have none)."""
    if len(chars) < n:
        return np.empty(0, np.uint64)
    powers, shift, h = {}, BASE, chars.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(1)
    with np.errstate(over="ignore"):
        span = 1
        powers[1] = (h, shift)
        while span * 2 <= n:
            h = h[:-span] * shift + h[span:]
            shift, span = shift * shift, span * 2
            powers[span] = (h, shift)
        out, have = powers[span][0], span
        for k in sorted(powers, reverse=True):
            while have + k <= n:
                part, mul = powers[k]
                size = len(chars) - have - k + 1
                out = out[:size] * mul + part[have : have + size]
                have += k
        return mixed(out)


def repeated(chars: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Marks the characters that lie in a run of ``n`` that occurred earlier in the same text."""
    covered = np.zeros(len(chars) + 1, np.int64)
    h = grams(chars, n)
    if len(h):
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        inside = np.nonzero(owner[: len(h)] == owner[n - 1 :])[0]
        with np.errstate(over="ignore"):
            key = h[inside] ^ mixed(owner[inside].astype(np.uint64) * BASE)
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = inside[order[1:][key[1:] == key[:-1]]]
        covered[again] += 1
        np.subtract.at(covered, again + n, 1)
    return np.cumsum(covered)[:-1] > 0
