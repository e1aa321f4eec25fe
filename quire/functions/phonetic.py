"""Pinyin: syllables, light tones, and the er of spoken words."""

from __future__ import annotations

import re

#: Fixed values.
TONED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜńňǹḿ"
VOWELS = "aeiouüê" + TONED
INITIAL = re.compile(r"(?:[zcs]h|[bpmfdtnlgkhjqxrzcsyw])(?=[" + VOWELS + "])", re.I)
TAIL = ("n", "ng", "m", "r")


def syllables(pinyin: str) -> list[str]:
    """Syllables in order: split at dots and apostrophes, and before each initial; stray tails join the one before."""
    out: list[str] = []
    for part in re.split(r"[·•'’\s-]+", pinyin.strip()):
        if not part:
            continue
        cuts = [m.start() for m in INITIAL.finditer(part) if m.start()]
        pieces = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]
        first = len(out)
        for piece in pieces:
            if len(out) > first and (piece in TAIL or not any(ch in VOWELS for ch in piece.lower())):
                out[-1] += piece
            else:
                out.append(piece)
    return out


def light_positions(pinyin: str) -> list[int]:
    """Indices of the syllables right after a dot, which are light."""
    out, n = [], 0
    for k, part in enumerate(re.split(r"[·•]", pinyin)):
        if k:
            out.append(n)
        n += len(syllables(part))
    return out


def has_tone(syllable: str) -> bool:
    return any(ch in TONED for ch in syllable.lower())


def requires_light(pinyin: str) -> bool:
    """Whether a light syllable is marked and none of them bears a tone; of parts joined by ``；`` any will do."""
    for part in pinyin.split("；"):
        s, light = syllables(part), light_positions(part)
        if light and not any(has_tone(s[k]) for k in light if k < len(s)):
            return True
    return False


def on_characters(word: str, pinyin: str) -> list[tuple[str, str | None]]:
    """Each character with its syllable; a final er written into the syllable before leaves 儿 without its own."""
    s = syllables(pinyin)
    chars = [ch for ch in word if "一" <= ch <= "鿿"]
    if len(s) == len(chars):
        return list(zip(chars, s))
    if len(s) == len(chars) - 1 and chars and chars[-1] == "儿" and s and s[-1].endswith("r"):
        return [*zip(chars[:-1], s), ("儿", None)]
    return [(ch, s[k] if k < len(s) else None) for k, ch in enumerate(chars)]


def er_kind(word: str, pinyin: str) -> str | None:
    """``attached`` where 儿 colours the syllable before, ``syllabic`` where it is one, None where there is none."""
    if "儿" not in word[1:]:
        return None
    return "attached" if any(ch == "儿" and x is None for ch, x in on_characters(word, pinyin)) else "syllabic"
