"""Numerals of headings: Chinese, Roman and Arabic."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Fixed values.
DIGITS = {**dict(zip("零一二三四五六七八九", range(10))), **dict(zip("壹贰叁肆伍陆柒捌玖", range(1, 10))), "〇": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000, "拾": 10}
GROUPS = {"万": 10_000, "亿": 100_000_000}
ROMAN = re.compile(r"M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
ROMAN_VALUES = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)))


def chinese(text: str) -> int | None:
    """The value of a Chinese numeral; a bare unit counts once; other characters make it none."""
    if not text or any(ch not in DIGITS and ch not in UNITS and ch not in GROUPS for ch in text):
        return None
    if all(ch in DIGITS for ch in text):  # read digit by digit
        return int("".join(str(DIGITS[ch]) for ch in text))
    total = group = digit = 0
    bare = True
    for ch in text:
        if ch in DIGITS:
            digit, bare = DIGITS[ch], DIGITS[ch] == 0
        elif ch in UNITS:
            group += (1 if bare and digit == 0 else digit) * UNITS[ch]
            digit, bare = 0, True
        else:
            total = (total + group + digit) * GROUPS[ch] if ch == "亿" else total + (group + digit) * GROUPS[ch]
            group = digit = 0
            bare = True
    return total + group + digit


def roman(text: str) -> int | None:
    """The value of a Roman numeral in strict form, whatever its case; zero is none."""
    t = text.upper()
    if not t or not ROMAN.fullmatch(t):
        return None
    values = [ROMAN_VALUES[ch] for ch in t]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0])) or None


def arabic(text: str) -> int | None:
    return int(text) if text.isdigit() else None


PARSERS = {"cn": chinese, "arabic": arabic, "roman": roman}


def first_value(groups: dict[str, str], order: list[str]) -> int | None:
    """The value by the first numeral system of the order that can read its group."""
    for system in order:
        if (raw := groups.get(system)) and (value := PARSERS[system](raw)) is not None:
            return value
    return None


@arrow_udf(T.LongType())
def zh_numeral(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else chinese(x) for x in c.to_pylist()], pa.int64())


@arrow_udf(T.LongType())
def roman_numeral(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else roman(x) for x in c.to_pylist()], pa.int64())
