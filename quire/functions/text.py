"""Column expressions on text; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: blanks as Unicode counts them (the JVM's ``\\s`` knows only those of ASCII).
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"
FULL_DIGITS = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
HALF_DIGITS = "".join(chr(ord(c) - 0xFEE0) for c in FULL_DIGITS)
HAN = r"[\x{4e00}-\x{9fff}]"


def squeeze(c: Column) -> Column:
    """Text without any blank."""
    return F.regexp_replace(c, BLANKS, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def normalize_sentence(c: Column, inner: bool = True) -> Column:
    """Trimmed text; with ``inner`` all blanks inside go too."""
    return squeeze(c) if inner else strip(c)


def fold_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def half_width(c: Column) -> Column:
    """Full-width digits and Latin letters to their ASCII forms."""
    return F.translate(c, FULL_DIGITS, HALF_DIGITS)


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.when(F.length(squeeze(c)) > 0, c) for c in cols))


def grams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a text shorter than ``n`` is its own only gram."""
    size = F.length(c)
    return F.when(size < n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))))


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Share of common n-grams: 0 if either text is empty, 1 if they are equal."""
    x, y = grams(a, n), grams(b, n)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def gram_positions(c: Column, n: int) -> Column:
    """``array<struct<pos, gram>>`` of all n-grams with 0-based positions; empty for shorter texts."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(0), F.length(c) - n), lambda i: F.struct(i.alias("pos"), F.substring(c, i + 1, n).alias("gram")))).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def characters(c: Column) -> Column:
    """The code points of a text in order."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines at every kind of line end; a last empty one is none."""
    parts = F.split(c, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def unescape(c: Column) -> Column:
    """The entities of plain HTML and the commonest typographic ones."""
    for name, ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("ldquo", "“"), ("rdquo", "”"), ("mdash", "—"), ("#8212", "—"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return c


def clean_title(c: Column) -> Column:
    """A title without footnote marks, blanks, dots, digits and circled numbers."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\^[^\]]*\]", ""), r"[\s\x{3000}.…\d①-⑩]", "")


def strip_trailing_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+$", "")


def is_headword(c: Column) -> Column:
    """Two characters or more, no digit of any kind, no Latin letter."""
    return (F.length(c) >= 2) & ~c.rlike(r"[\p{Nd}\p{No}A-Za-z]")


def is_han(c: Column) -> Column:
    return c.rlike(f"^{HAN}$")


def window(text: Column, start: Column, end: Column, radius: int = 60) -> Column:
    """Text around ``[start, end)``, with an ellipsis at each cut end, blanks squeezed to one."""
    low, high = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    body = F.regexp_replace(F.substring(text, low + 1, high - low), f"{BLANKS}+", " ")
    return F.concat(F.when(low > 0, "…").otherwise(""), F.trim(body), F.when(high < F.length(text), "…").otherwise(""))


def drop_images(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)(?:\{[^}]*\})?", "")


def drop_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n\s*\n+", "\n")


def json_findings(c: Column) -> Column:
    """The findings of a model's answer: ``array<map>``; null where the answer is no answer.

    A code fence is stripped. An object counts by ``findings`` (empty is clean) or else by a filled ``issues``,
    ``changes`` or ``corrections``; a bare array counts as it is.
    """
    body = F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    rows = "array<map<string,string>>"
    bare = F.when(body.startswith("["), F.from_json(body, rows))
    keys = [F.from_json(F.get_json_object(body, f"$.{k}"), rows) for k in ("findings", "issues", "changes", "corrections")]
    filled = [F.when(F.size(k) > 0, k) for k in keys[1:]]
    return F.coalesce(bare, keys[0], *filled)


def features(c: Column) -> dict[str, Column]:
    """Shares of character kinds and marks, length, digits: the features of the text classifier."""
    size = F.greatest(F.length(c), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / size

    digits = F.regexp_count(c, F.lit(r"[0-9]+"))
    return {
        "han_share": share(HAN),
        "latin_share": share("[A-Za-z]"),
        "digit_share": share("[0-9]"),
        "blank_share": share(BLANKS),
        "comma_share": share("[，,、]"),
        "stop_share": share("[。.]"),
        "ask_share": share("[？?！!]"),
        "length": F.length(c),
        "numbers": digits,
        "number_length": F.when(digits > 0, (F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))) / digits).otherwise(F.lit(0.0)),
    }
