"""Problem 5: text decoded with the wrong character encoding.

A multinomial classifier on hashed byte bigrams knows clean text and text that went through each of
CHAINS, a pair of the encoding the bytes were in and the one they were read as. It is trained on the pairs of bytes of all
rows and of copies of them garbled by each chain. Every text is scored by position; the
stretches that a chain explains better than clean text are candidates. The predicted chain is inverted
there and counts where the bytes decode strictly to characters that clean text uses; these are counted in
all rows, for they decide exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, spread, table

#: (encoding of the bytes, encoding they were read as); "cp1252" falls back to Latin-1 for its holes.
CHAINS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "big5"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp949"), ("utf-8", "mac-roman"), ("utf-8", "cp850"),
    ("gb18030", "cp1252"), ("gb18030", "utf-8"), ("gb18030", "big5"), ("gb18030", "cp932"), ("gb18030", "cp437"), ("big5", "cp1252"), ("big5", "gb18030"), ("cp932", "cp1252"), ("cp932", "gb18030"), ("cp932", "utf-8"), ("euc-jp", "gb18030"), ("euc-jp", "cp1252"), ("cp949", "cp1252"), ("cp949", "gb18030"), ("cp949", "utf-8"),
    ("cp1252", "utf-8"), ("cp1252", "gb18030"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac-roman"), ("cp1252", "cp1251"), ("cp437", "cp1252"), ("mac-roman", "cp1252"), ("cp1252", "cp932"), ("cp1252", "big5"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "utf-8"), ("cp1251", "gb18030"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1256", "cp1252"), ("cp1256", "utf-8"), ("cp874", "cp1252"), ("cp874", "utf-8"), ("cp1251", "mac-roman"),
]

BUCKETS = 1 << 15
SMOOTH = 0.05
DRIFT = 1.0  # by how much clean text falls a byte
ONSET = 6.0  # log odds from which a stretch is a candidate
COMMON = 3  # undamaged rows that must use a character
EACH = 6000  # rows of which COMMON must use it, for the model that tells garbled places from others
SHARE = 50_000  # one undamaged row in so many must use it
KEPT = 4  # rows that must keep it for each that loses it by a repair

#: Replacement characters, C1 controls but NEL, and private use: signs of damage wherever they stand.
DAMAGE = re.compile("[�\x80-\x84\x86-\x9f-\U000f0000-\U0010fffd]")

CP1252 = {}
for _b in range(128, 256):
    try:
        CP1252[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        CP1252[chr(_b)] = _b
UN1252 = {_b: _ch for _ch, _b in CP1252.items()}

ROWS = "chunk_id long, chain string, restored string, fixes int, damage int"


def read_as(data: bytes, encoding: str) -> str:
    """Bytes read with an encoding, as sloppily as programs do."""
    if encoding == "cp1252":
        return "".join(chr(b) if b < 128 else UN1252[b] for b in data)
    return data.decode(encoding, "replace")


def garble(text: str, chain: tuple[str, str]) -> str:
    return read_as(text.encode(chain[0], "ignore"), chain[1])


@lru_cache(maxsize=64)  # the chains tried on a stretch share their readings
def bytes_of(text: str, encoding: str) -> tuple[bytes | None, ...]:
    """Bytes of each character in the encoding it was read as, None where it has none."""
    out: list[bytes | None] = []
    for ch in text:
        o = ord(ch)
        if o < 128:
            out.append(ch.encode())
        elif encoding in ("cp1252", "latin-1"):
            b = CP1252.get(ch) if encoding == "cp1252" or o > 255 else o
            if b is None and 128 <= o < 160:
                b = o
            out.append(None if b is None else bytes([b]))
        else:
            try:
                out.append(ch.encode(encoding))
            except UnicodeEncodeError:
                out.append(bytes([o]) if 128 <= o < 160 else None)
    return tuple(out)


UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
DOUBLE = re.compile(rb"(?:[\x81-\xfe][\x30-\x7e\x80-\xfe]|[\x80-\xff])+")
SINGLE = re.compile(rb"[\x80-\xff]+")
DOUBLES = frozenset(("gb18030", "big5", "cp932", "euc-jp", "cp949"))


@dataclass
class Model:
    best: np.ndarray  # by bucket: the highest log odds of any chain against clean
    odds: np.ndarray  # bucket x chain
    common: frozenset[str] = field(default_factory=frozenset)
    pairs: dict[str, int] = field(default_factory=dict)  # small-letter bigrams of clean words, those with a letter beyond ASCII


def bigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte with the one after it."""
    return (data[:-1].astype(np.int32) * 257 + data[1:].astype(np.int32) * 31) & (BUCKETS - 1)


RIGHTS = list(dict.fromkeys(right for right, _ in CHAINS))
#: What pairs of bytes are counted in: clean texts; the lines that each encoding can hold, as UTF-8 and in it; and those lines
#: garbled by each chain that reads several bytes as one character. All that reads single bytes follows from the pairs before.
STREAMS = [
    ("clean", ""),
    *(("lines", right) for right in RIGHTS),
    *(("bytes", right) for right in RIGHTS if right != "utf-8"),
    *(chain for chain in CHAINS if chain[1] in DOUBLES or chain[1] == "utf-8"),
]
STREAM = {x: k for k, x in enumerate(STREAMS)}
PAIRS = 1 << 16
BUCKET_OF = (np.arange(PAIRS) % 256 * 257 + np.arange(PAIRS) // 256 * 31) & (BUCKETS - 1)  # of a pair, the first byte low
#: No encoding of single bytes holds these.
NO_SINGLE = re.compile("[⺀-퟿]")
UPPER_CASED = re.compile("[\xc0-\xd6\xd8-\xf6\xf8-\u024fЀ-ԯ]")
READ_1252 = "".join(chr(b) if b < 128 else UN1252[b] for b in range(256))


def pairs_of(data: bytes) -> np.ndarray:
    """How often each pair of neighbouring bytes occurs."""
    n = np.zeros(PAIRS, np.int64)
    for skip in (0, 1):
        k = (len(data) - skip) // 2
        if k > 0:
            n += np.bincount(np.frombuffer(data, "<u2", k, skip), minlength=PAIRS)
    return n


@dataclass
class Tally:
    """What the classifier is fitted on, counted in clean texts."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros((len(STREAMS), PAIRS), np.int64))  # stream x pair of bytes
    chars: Counter[str] = field(default_factory=Counter)  # texts that use a character
    letters: Counter[str] = field(default_factory=Counter)  # small-letter bigrams of words, those with a letter beyond ASCII
    rows: int = 0

    def add(self, clean: list[str]) -> None:
        """Counts texts; each line counts for itself, with the ends of line around it, so that the counts of parts add up."""
        self.rows += len(clean)
        lines: dict[str, list[str]] = {right: [] for right in RIGHTS}
        for t in clean:
            self.chars.update(set(t))
            if UPPER_CASED.search(t):
                self.letters.update(x for w in CASED_WORD.findall(t.lower()) if not w.isascii() for x in map("".join, zip(w, w[1:])) if not x.isascii())
            for line in t.split("\n"):
                if not line.isascii():
                    dense = NO_SINGLE.search(line)
                    for right, have in lines.items():
                        if right in ("utf-8", "gb18030"):
                            have.append(line)
                        elif not dense or right in DOUBLES:
                            try:
                                line.encode(right)
                                have.append(line)
                            except UnicodeEncodeError:
                                pass
        self._count(("clean", ""), clean)
        for right, have in lines.items():
            if have:
                data = self._count(("lines", right), have)
                if right != "utf-8":
                    data = "\n".join(["", *have, ""]).encode(right, "ignore")
                    self.pairs[STREAM["bytes", right]] += pairs_of(data)
                for chain in CHAINS:
                    if chain[0] == right and chain in STREAM:
                        self.pairs[STREAM[chain]] += pairs_of(data.decode(chain[1], "replace").encode("utf-8", "ignore"))

    def _count(self, stream: tuple[str, str], texts: list[str]) -> bytes:
        data = "\n".join(["", *texts, ""]).encode("utf-8", "ignore")
        self.pairs[STREAM[stream]] += pairs_of(data)
        return data

    def without(self, other: Tally) -> Tally:
        return Tally(self.pairs - other.pairs, self.chars - other.chars, self.letters - other.letters, self.rows - other.rows)

    def of_chain(self, chain: tuple[str, str]) -> np.ndarray:
        """Pairs of bytes of the lines garbled by a chain."""
        if chain in STREAM:
            return self.pairs[STREAM[chain]]
        right, wrong = chain
        raw = self.pairs[STREAM["lines" if right == "utf-8" else "bytes", right]].reshape(256, 256)  # byte after, byte
        read = [(READ_1252[b] if wrong == "cp1252" else bytes([b]).decode(wrong, "replace")).encode() for b in range(256)]
        first, last = (np.array([x[k] for x in read]) for k in (0, -1))
        out = np.zeros((256, 256), np.int64)
        np.add.at(out, (first[:, None], last[None, :]), raw)
        for b, n in enumerate(raw.sum(0).tolist()):
            for x, y in zip(read[b], read[b][1:]):
                out[y, x] += n
        return out.reshape(PAIRS)


def fit(texts: list[str]) -> Model:
    """Fits the classifier twice; the second time without the texts that the first one repairs."""
    every, bad = Tally(), Tally()
    clean = [t for t in texts if t and not DAMAGE.search(t)]
    every.add(clean)
    bad.add(repaired(clean, model_of(every)))
    return model_of(every.without(bad))


def repaired(clean: list[str], model: Model) -> list[str]:
    """The texts that the model repairs."""
    return [clean[k] for k in scan(clean, model) if restore(clean[k], model)[2]]


def model_of(tally: Tally) -> Model:
    def buckets(pairs: np.ndarray) -> np.ndarray:
        return np.bincount(BUCKET_OF, pairs, BUCKETS)

    def log_shares(pairs: np.ndarray) -> np.ndarray:
        n = buckets(pairs)
        return np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))

    odds = np.empty((BUCKETS, len(CHAINS)), np.float32)
    clean = tally.pairs[STREAM["clean", ""]]
    # a chain only takes lines of its languages; clean text is as good as the best of the same choices
    base = np.max([log_shares(clean), *(log_shares(tally.pairs[STREAM["lines", right]]) for right in RIGHTS)], 0)
    for c, chain in enumerate(CHAINS):
        odds[:, c] = log_shares(tally.of_chain(chain)) - base
    odds = np.clip(odds, -6, 6)
    best = odds.max(1)
    # the best of many chains is above zero by chance; the drift makes clean text fall on average
    n = buckets(clean)
    drift = float((n * best).sum() / n.sum()) + DRIFT if n.any() else DRIFT
    least = COMMON * max(1.0, tally.rows / EACH)
    return Model(best - np.float32(drift), odds, frozenset(ch for ch, n in tally.chars.items() if n >= least), {x: n for x, n in tally.letters.items() if n >= least})


def plausible(text: str, common: frozenset[str], share: float) -> bool:
    """Whether at least ``share`` of the characters that are no ASCII are ones that clean text uses; none is a control."""
    high = [ch for ch in text if not ch.isascii()]
    return bool(high) and not DAMAGE.search(text) and sum(ch in common for ch in high) >= share * len(high)


def repair(text: str, chain: tuple[str, str], common: frozenset[str], low: int, high: int, sure: bool = False) -> tuple[str, int]:
    """Inverts the chain where its bytes decode strictly within ``low..high``; ``(text, places)``. ``sure``: the stretch is known to be of this chain."""
    right, wrong = chain
    if wrong == "utf-8":
        return text, 0  # the bytes are gone
    parts = bytes_of(text[low:high], wrong)
    kind = UTF8 if right == "utf-8" else DOUBLE if {right, wrong} & DOUBLES else SINGLE
    out, fixes, k = [text[:low]], 0, 0
    while k < len(parts):
        if parts[k] is None:
            out.append(text[low + k])
            k += 1
            continue
        end = k
        while end < len(parts) and parts[end] is not None:
            end += 1
        data, at, char_at = b"".join(parts[k:end]), 0, {}
        if not kind.search(data):
            out.append(text[low + k : low + end])
            k = end
            continue
        for j in range(k, end):
            char_at[at] = j
            at += len(parts[j])
        char_at[at] = end
        pos, done = 0, k
        for m in kind.finditer(data):
            a, b = m.span()
            # both ends must be ends of a character as it was and as it is read now
            both = [x for x in (range(a, b + 1) if right != "utf-8" else [k for k in range(a, b) if data[k] & 0xC0 != 0x80] + [b]) if x in char_at]
            if len(both) < 2:
                continue
            a, b = both[0], both[-1]
            if right == "utf-8" and wrong in ("gb18030", "big5", "cp932", "cp949"):  # a clean character at either end may pass for two bytes
                while b - a > 2 and a + 2 in char_at and data[a] < 0xE0 and data[a : a + 2].decode("utf-8", "replace") not in common:
                    a += 2
                while b - a > 2 and b - 2 in char_at and 0xC2 <= data[b - 2] < 0xE0 and data[b - 2 : b].decode("utf-8", "replace") not in common:
                    b -= 2
            if a >= b or a < pos:
                continue
            raw, was = data[a:b], text[low + char_at[a] : low + char_at[b]]
            try:
                now = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if was != now and credible(was, now, chain, common, text, low + char_at[a], low + char_at[b], sure):
                out.append(text[low + done : low + char_at[a]] + now)
                done, pos, fixes = char_at[b], b, fixes + 1
        out.append(text[low + done : low + end])
        k = end
    return "".join(out) + text[high:], fixes


LATIN_SIDE = re.compile("[A-Za-zÀ-ɏ]")


def credible(was: str, now: str, chain: tuple[str, str], common: frozenset[str], text: str, a: int, b: int, sure: bool = False) -> bool:
    """The exact check of one inverted place: strict bytes are a strong sign for UTF-8 and a weak one for others.

    Where the stretch is known to be of the chain, a place need not look odd as it stands.
    """
    if any("\ufb00" <= ch <= "\ufb06" for ch in was):  # ligatures are a form, no damage
        return False
    near = text[max(0, a - 1) : a] + text[b : b + 1]
    script = {ord(ch) >> 8 for ch in near if ord(ch) > 0x36F}
    mixed = len(was) > 1 and any(ch.isalpha() for ch in was) and all("\xa1" <= ch <= "\xff" and ch != "\xad" for ch in was) and bool(now) and ord(now[0]) >> 8 in script
    odd = sum(ch not in common or mixed and not ch.isascii() for ch in was)
    high = sum(not ch.isascii() for ch in was)
    if chain[0] != "utf-8" and len(now) < 3 and LATIN_SIDE.search(near) and not LATIN_SIDE.search(now):
        return False  # one or two foreign letters in a Latin word
    if sure:
        return plausible(now, common, 0.5 if chain[0] == "utf-8" else 1) and not (chain[0] != "utf-8" and now.isascii())
    if chain[0] == "utf-8":
        return plausible(now, common, 0.5) and (odd > 0 or high >= 4 and chain[1] in ("cp1252", "latin-1"))
    if not plausible(now, common, 1):
        return False
    if all(ord(ch) < 0x250 for ch in now):  # a Latin letter: it must stand in a Latin word and have been no small letter
        if was[0] in "“”‘’„…—–«»" and not (LATIN_SIDE.search(text[max(0, a - 1) : a]) and LATIN_SIDE.search(text[b : b + 1])):
            return False  # a mark beside a word is a mark
        return odd > 0 and len(now) <= 3 and not was.islower() and bool(LATIN_SIDE.search(near)) and any(ch.isalpha() for ch in now)
    return odd > 0 and (odd == high or chain[1] == "cp1252" and odd * 2 >= high and len(now) > 1)


def stretches(values: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal-scoring stretches above ONSET, left to right."""
    out, total, start, peak, peak_at = [], 0.0, 0, 0.0, -1
    for k, v in enumerate(values.tolist()):
        if total <= 0:
            if peak >= ONSET:
                out.append((start, peak_at + 1, peak))
            total, start, peak = 0.0, k, 0.0
        total += v
        if total > peak:
            peak, peak_at = total, k
        elif peak >= ONSET and total < peak - ONSET:
            out.append((start, peak_at + 1, peak))
            total, peak = 0.0, 0.0
    if peak >= ONSET:
        out.append((start, peak_at + 1, peak))
    return out


#: A run of Latin-1 letters or signs as those of a misread multi-byte text, all of them in use elsewhere.
_HIGH = "".join(re.escape(ch) for ch in CP1252)
MIXED = re.compile(f"[\xa1-\xff][\xa1-\xff{_HIGH}]|[{_HIGH}][\xa1-\xff]")
LONG = 240  # bytes from which a stretch tells its chain so clearly that three are compared
TRIES = 12  # chains compared on a stretch, best first


#: Words of scripts with two cases, and a place in one where the case is odd: a capital after a small letter, or three capitals beyond ASCII.
CASED_WORD = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024fЀ-ԯ]+")
ODD_CASE = re.compile("[a-z\xdf-\xf6\xf8-\xffа-џ][\xc0-\xd6\xd8-\xdeŒŠŸŽЀ-Я]|[Ѐ-Я]{3}")
CAPITALS = re.compile("[\xc0-\xd6\xd8-\xdeŒŠŸŽЀ-Я]+")
SINGLE_CHAINS = [k for k, chain in enumerate(CHAINS) if "utf-8" not in chain and not DOUBLES & set(chain)]


def unswapped(text: str, model: Model) -> tuple[str, str, int]:
    """``(chain, text, places)`` after the repair of letters that one single-byte encoding for another turned into capitals.

    All their characters are in use, so the bigrams of the word decide: those of the word with the chain inverted are all known, those
    of the word as it stands are not.
    """
    names: list[str] = []

    def known(word: str) -> int:
        pairs = [x for x in map("".join, zip(word.lower(), word.lower()[1:])) if not x.isascii()]
        return min((model.pairs.get(x, 0) for x in pairs), default=0)

    def word(m: re.Match) -> str:
        was = m[0]
        if not ODD_CASE.search(was) or known(was):
            return was
        best = (False, 0, "", "")  # the word as a whole comes first
        whole = [(0, len(was))] if len(was) > 2 and was[1:].isupper() and not was.isascii() else []
        for a, b in [*whole, *(x.span() for x in CAPITALS.finditer(was))]:
            for k in SINGLE_CHAINS:
                right, wrong = CHAINS[k]
                parts = bytes_of(was[a:b], wrong)
                if None in parts:
                    continue
                try:
                    now = b"".join(parts).decode(right)
                except UnicodeDecodeError:
                    continue
                fixed = was[:a] + now + was[b:]
                if now.isalpha() and (now.islower() or a == 0 and now[1:].islower() and now[0].isupper()) and CASED_WORD.fullmatch(fixed):
                    score = known(fixed)
                    best = max(best, (score > 0 and b - a == len(was), score, fixed, ">".join(CHAINS[k])))
        if best[1]:
            names.append(best[3])
            return best[2]
        return was

    now = CASED_WORD.sub(word, text) if ODD_CASE.search(text) else text
    return names[0] if names else "", now, len(names)


#: Single-byte encodings of other scripts, and readings whose letters those scripts don't have.
NON_LATIN, LATIN_READ = frozenset(("cp1251", "koi8-r", "cp866", "cp1256", "cp874")), frozenset(("cp1252", "latin-1", "mac-roman", "cp437", "cp850"))


def restore(text: str, model: Model) -> tuple[str, str, int, int]:
    """``(chain, restored text, repaired places, damaged characters left)`` of a text that has candidates."""
    chain, text, fixes, _ = _restore(text, model)
    swapped, text, more = unswapped(text, model)
    return chain or swapped, text, fixes + more, len(DAMAGE.findall(text))


def _restore(text: str, model: Model) -> tuple[str, str, int, int]:
    """``(chain, restored text, repaired places, damaged characters left)`` of a text that has candidates."""
    if model.common.issuperset(text) and not MIXED.search(text):
        return "", text, 0, 0  # no place in it could pass the exact check
    data = text.encode("utf-8", "replace")
    pairs = bigrams(np.frombuffer(data, np.uint8)) if len(data) > 1 else np.zeros(0, np.int32)
    at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # character of each byte
    chain_name, fixes = "", 0
    used: set[tuple[str, str]] = set()
    spans = []
    for a, b, _ in stretches(model.best[pairs]):
        spans.append((int(at[a]), int(at[min(b, len(at) - 1)]) + 1, a, b))
    for low, high, a, b in reversed(spans):
        low, high = max(0, low - 4), min(len(text), high + 4)
        if model.common.issuperset(text[low:high]) and not MIXED.search(text, low, high):
            continue  # no place in it could pass the exact check
        run = np.cumsum(model.odds[pairs[a:b]], 0)
        sums = (run - np.minimum(np.minimum.accumulate(run), 0)).max(0)  # each chain by its own best part
        chains, tries = np.argsort(-sums).tolist(), TRIES if b - a < LONG else 3
        picked = None
        letters = [ch for ch in text[low:high] if ch.isalpha()]
        foreign = sum("\x80" <= ch <= "\u024f" for ch in letters) >= 0.7 * len(letters)  # no language of Latin letters has so many of them
        for k, c in enumerate(chains):
            if k >= tries:
                # where none of the likelier chains gives a repair, the rest of those whose strict bytes are a strong sign are tried
                if picked:
                    break
                if CHAINS[c][0] != "utf-8":
                    continue
            got, n = repair(text, CHAINS[c], model.common, low, high)
            left = sum(ch not in model.common for ch in got[low : high + len(got) - len(text)])
            if n and (picked is None or left < picked[3]):
                picked = (c, got, n, left)
        if picked:
            tail = len(text) - high
            text, fixes = picked[1], fixes + picked[2]
            chain = CHAINS[picked[0]]
            if chain[1] not in DOUBLES and (chain[0] == "utf-8" or chain[0] in DOUBLES and picked[2] > 1 or chain[0] in NON_LATIN and chain[1] in LATIN_READ and foreign):
                text, n = repair(text, chain, model.common, low, len(text) - tail, True)  # what is left in the stretch is of the same chain
                fixes += n
                used.update({chain} if chain[0] == "utf-8" else ())
            chain_name = ">".join(CHAINS[picked[0]])
            for c in chains[:tries]:  # twice garbled
                again, n = repair(text, CHAINS[c], model.common, low, len(text) - tail)
                if n:
                    text, fixes = again, fixes + n
                    break
    for chain in sorted(used):  # and of a chain whose strict bytes are a strong sign what is left in the text
        text, n = repair(text, chain, model.common, 0, len(text), True)
        fixes += n
    return chain_name, text, fixes, len(DAMAGE.findall(text))


def scan(texts: list[str], model: Model) -> list[int]:
    """Indices of the texts with a stretch above ONSET."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data) < 2:
        return []
    v = model.best[bigrams(data)]
    ends = np.cumsum([len(r) for r in raw])
    out = []
    start = 0
    for k, end in enumerate(ends.tolist()):
        s = np.cumsum(v[start : end - 1])
        if len(s) and (s - np.minimum(np.minimum.accumulate(s), 0)).max() >= ONSET:
            out.append(k)
        start = end
    return out


def restored(chunks: DataFrame, model: Model) -> DataFrame:
    """``chunk_id, chain, restored, fixes, damage``: rows whose target holds garbled text.

    ``fixes`` counts repaired places and ``damage`` what is lost (replacement characters, stray controls, private
    use) and remains as it was. Null and empty targets are no case; repeated rows come out each for itself.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        found = []
        for k in sorted({*scan(texts, shared.value), *(k for k, t in enumerate(texts) if DAMAGE.search(t) or ODD_CASE.search(t))}):
            chain, text, fixes, damage = restore(texts[k], shared.value)
            if fixes or damage:
                found.append((k, chain or None, text, fixes, damage))
        if not found:
            return None
        k, chain, text, fixes, damage = zip(*found)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(chain, pa.string()), pa.array(text, pa.string()), pa.array(fixes, pa.int32()), pa.array(damage, pa.int32())], ["chunk_id", "chain", "restored", "fixes", "damage"])

    return arrow_map(chunks.select(F.col("chunk_id").cast("long"), "target"), rows, ROWS)


def in_use(chunks: DataFrame, model: Model) -> frozenset[str]:
    """The characters that undamaged rows use, counted in all rows; ``model`` tells places that are garbled.

    A character counts if it is kept in COMMON rows and one in SHARE of all, and in KEPT for each row that loses it by a repair.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t for t in batch.column(0).to_pylist() if t and not DAMAGE.search(t)]
        kept, lost = Counter(), Counter()
        picked = set(scan(texts, shared.value))
        for k, text in enumerate(texts):
            chars = set(text)
            if k in picked:
                _, now, fixes, _ = restore(text, shared.value)
                if fixes:
                    lost.update(chars.difference(now))
                    chars.intersection_update(now)
            kept.update(chars)
        every = list(kept | lost)
        codes, n = [-1, *map(ord, every)], [len(texts), *(kept[ch] for ch in every)]
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(n, pa.int64()), pa.array([0, *(lost[ch] for ch in every)], pa.int64())], ["code", "kept", "lost"])

    counts = arrow_map(chunks.select("target"), rows, "code int, kept long, lost long").groupBy("code").agg(F.sum("kept").alias("kept"), F.sum("lost").alias("lost"))
    have = {r["code"]: r["kept"] for r in counts.where((F.col("kept") >= COMMON) & (F.col("kept") >= KEPT * F.col("lost")) | (F.col("code") < 0)).collect()}
    least = have.pop(-1, 0) / SHARE
    return frozenset(chr(code) for code, n in have.items() if n >= least)


def tallied(chunks: DataFrame, pick: Callable[[list[str]], list[str]]) -> Tally:
    """The counts of what ``pick`` leaves of the clean targets of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch):
                tally.add(pick([t for t in part.column(0).to_pylist() if t and not DAMAGE.search(t)]))
        at = np.flatnonzero(tally.pairs)
        counts = [(f"c{ch}", n) for ch, n in tally.chars.items()] + [(f"l{x}", n) for x, n in tally.letters.items()] + [("rows", tally.rows)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.array(tally.pairs.flat[at], pa.int64())], ["pair", "what", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int32()), *(pa.array(x, t) for x, t in zip(zip(*counts), (pa.string(), pa.int64())))], ["pair", "what", "n"])

    counts = chunks.select("target").mapInArrow(run, "pair int, what string, n long").groupBy("pair", "what").agg(F.sum("n").alias("n")).toArrow()
    out = Tally()
    is_pair = counts["what"].is_null()
    at = counts.filter(is_pair)
    out.pairs.flat[at["pair"].to_numpy()] = at["n"].to_numpy()
    rest = counts.filter(counts["what"].is_valid())
    for what, n in zip(rest["what"].to_pylist(), rest["n"].to_pylist()):
        if what == "rows":
            out.rows = n
        else:
            (out.chars if what[0] == "c" else out.letters)[what[1:]] = n
    return out


def fitted(chunks: DataFrame) -> Model:
    """The classifier, fitted as by ``fit`` on all rows, with the characters in use."""
    chunks = spread(chunks)
    every = tallied(chunks, lambda texts: texts)
    first = chunks.sparkSession.sparkContext.broadcast(model_of(every))
    model = model_of(every.without(tallied(chunks, lambda texts: repaired(texts, first.value))))
    return replace(model, common=in_use(chunks, model))


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "your_markdown", "chunk_id", "target")
    return restored(spread(chunks), fitted(chunks))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(spark, sf_dir).select("chunk_id")
