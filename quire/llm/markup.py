"""Problem 2: markup residue.

A tokenizer knows the constructs of HTML, Markdown, wiki text and LaTeX. Words score positive and
constructs negative, with weights learned from lines whose words and constructs were counted on a bounded
sample; one linear scan finds the maximum-scoring subsequence, the content region, and constructs
beyond its ends are dropped as page frame. Inside it constructs are converted: headings, lists, code,
tables and formulas stay recognisable in one plain notation, and their spans are returned.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, sample, spread, table

#: Element names of HTML.
HTML_NAMES = """a abbr acronym address article aside audio b base big blockquote body br button caption center cite code col colgroup dd del details dfn dir div dl dt em embed
fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol
option p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr""".split()

_NAME = "|".join(sorted(HTML_NAMES, key=len, reverse=True))
_TAG = rf"</?(?:{_NAME})(?:\s[^<>]*)?/?>"

#: (language, construct, pattern), in the order in which they are looked for at one place.
CONSTRUCTS = [
    ("html", "comment", r"<!DOCTYPE[^>]*>"),
    ("html", "tag", _TAG),
    ("html", "entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});"),
    ("wiki", "nowiki", r"</?(?:nowiki|ref|references|gallery|includeonly|noinclude|onlyinclude|syntaxhighlight|math|poem)\b[^<>]*>"),
    ("latex", "environment", r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}"),
    ("latex", "formula", r"\$\$[^$]*(?:\\[A-Za-z]+|[_^={}])[^$]*\$\$|\$(?!\d[\d.,]*[^\d\s\\$^_{}=+*/<>-])[^$\n]*(?:\n[^$\n]+)?(?:\\[A-Za-z]+|[_^]\{?|=)[^$\n]*(?:\n[^$\n]+)?\$|\$[A-Za-z]\$"),
    ("latex", "command", r"(?<![A-Za-z]:)(?<!\\)\\(?:(?:chapter|(?:sub){0,2}section|(?:sub)?paragraph|part|caption|label|ref|eqref|cite[pt]?|footnote|emph|text[a-z]{2}|textnormal|textcolor|underline|uline|mbox|hbox|fbox|makebox|url|href|includegraphics|title|author|date|input|include|bibliography|usepackage|documentclass|newcommand|vspace|hspace|item|maketitle|tableofcontents|noindent|newpage|clearpage|centering|hline|par|bigskip|medskip|smallskip|LaTeX|TeX|ldots|dots|quad|qquad|frac|sqrt|sum|int|prod|alpha|beta|gamma|delta|theta|lambda|mu|pi|sigma|omega|leq|geq|neq|times|cdot|infty|left|right|mathbb|mathrm|it|bf|em|tt|rm|sc|sl|large|Large|small|footnotesize|tiny)(?![A-Za-z])\*?)|\{\\(?:it|bf|em|tt|sc|rm|sl)\b"),
    ("wiki", "table", r"(?m:^\s*\{\|.*$|^\s*\|\}\s*$|^[ \t]*\|-(?![-:|])[^|\n]*$)"),
    ("wiki", "link", r"\[\[[^\[\]\n]*(?:\n[^\[\]\n]+)?\]\]"),
    ("wiki", "external", r"\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*(?:\n[^\]\n]+)?)?\]"),
    ("wiki", "heading", r"(?m:^(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*\r?$)"),
    ("wiki", "emphasis", r"'''''[^'\n]+(?:\n[^'\n]+)?'''''|'''[^'\n]+(?:'[^'\n]+)*(?:\n[^'\n]+)?'''|(?<!')''[^'\n]+(?:'[^'\n]+)*(?:\n[^'\n]+)?''(?!')"),
    ("wiki", "definition", r"(?m:^;[ \t]*'''|^;[ \t]+\S[^\n]*\n:[ \t]+(?=\S)|^\#REDIRECT\b)"),
    ("markdown", "fence", r"(?m:^[ \t]*(?P<fence>`{3,}|~{3,})[^`~\n]*\r?$)(?:.*?(?m:^[ \t]*(?P=fence)[`~]*[ \t]*\r?$)|)"),
    ("markdown", "heading", r"(?m:^[\ufeff]? {0,3}\#{1,6}[ \t\u3000]+\S)"),
    ("markdown", "setext", r"(?m:(?<=\S)[ \t]*\r?\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*\r?$)"),
    ("markdown", "image", r"!\[[^\[\]\n]*(?:\n[^\[\]\n]+)?\]\([^()\s]*(?:\s[^()\n]*)?\)"),
    ("markdown", "link", r"\[[^\[\]\n]*(?:\n[^\[\]\n]+)?\]\((?:[^()\s]|\n)+(?:\s[^()\n]*)?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?m:^\[[^\[\]^\n]+\]:[ \t]*\S+)|<https?://[^<>\s]+>"),
    ("markdown", "footnote", r"\[\^[^\[\]\s]+\]:?"),
    ("markdown", "table", r"(?m:^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\r?$)"),
    ("markdown", "quote", r"(?m:^ {0,3}>[ \t]?(?!\s*\d+[，,])(?=\S))"),
    ("markdown", "list", r"(?m:^[ \t]*[-+*][ \t]+(?!\d+[ \t]*\r?$)(?=[^\s*_-]))"),
    ("markdown", "strong", r"\*\*\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=\S)\*\*\*|\*\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=\S)\*\*|(?<!_)__(?=[^\s_])[^\n]*?(?:\n[^_\n]+)?(?<=[^\s_])__(?!_)"),
    ("markdown", "emphasis", r"(?<![*\\])(?<!\d)\*(?=[^\s*])[^*\n]+(?:\n[^*\n]+)?(?:(?<=[^\s*\d])\*(?!\*)|(?<=\d)\*(?![*\d]))|(?<=\d)\*(?=[^\s*\d])[^*\n]+(?:\n[^*\n]+)?(?:(?<=[^\s*\d])\*(?!\*)|(?<=\d)\*(?![*\d]))|(?<![\w_\\/])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_/])"),
    ("markdown", "strike", r"(?<!~)~~(?=[^\s~])[^~\n]+(?:\n[^~\n]+)?~~(?!~)"),
    ("markdown", "code", r"(?<!`)`(?!`)[^`\n]+(?:\n[^`\n]+)?`(?!`)"),
    ("markdown", "rule", r"(?m:^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]+){2,}-)[ \t]*\r?$)"),
]

PATTERNS = [(lang, kind, re.compile(p, re.S | re.I if lang == "html" else re.S)) for lang, kind, p in CONSTRUCTS]

Span = tuple[int, int]


def delimited(text: str, opener: re.Pattern, closer: re.Pattern) -> list[Span]:
    """Stretches from an opener to the next closer, of any length; one scan, for no opener after the last closer is looked at."""
    out, at = [], 0
    while (a := opener.search(text, at)) and (b := closer.search(text, a.end())):
        out.append((a.start(), b.end()))
        at = b.end()
    return out


def balanced(text: str, mark: re.Pattern, opener: str) -> list[Span]:
    """Outermost stretches between marks that open and close, nested to any depth."""
    out: list[Span] = []
    stack: list[int] = []
    for m in mark.finditer(text):
        if m[0] == opener:
            stack.append(m.start())
        elif stack:
            a = stack.pop()
            while out and out[-1][0] > a:
                out.pop()
            out.append((a, m.end()))
    return out


def alternating(text: str, mark: re.Pattern, opener: str) -> list[Span]:
    """Stretches between an opener and a closer with neither between them."""
    out, a = [], -1
    for m in mark.finditer(text):
        if m[0] == opener:
            a = m.start()
        elif a >= 0:
            out.append((a, m.end()))
            a = -1
    return out


_LONE_BRACE = re.compile(r"(?<!\{)\{(?!\{)|(?<!\})\}(?!\})")
_COMMENT, _CDATA, _PRE = ((re.compile(a, re.I), re.compile(b, re.I)) for a, b in ((r"<!--", r"-->"), (r"<!\[CDATA\[", r"\]\]>"), (r"<pre\b[^>]*>", r"</pre\s*>")))
_BRACES, _ROUND, _SQUARE = re.compile(r"\{\{|\}\}"), re.compile(r"\\[()]"), re.compile(r"\\[\[\]]")


def comments(text: str) -> list[Span]:
    return delimited(text, *_COMMENT) + delimited(text, *_CDATA) if "<!" in text else []


def preformatted(text: str) -> list[Span]:
    return delimited(text, *_PRE) if "</" in text else []


def display_formulas(text: str) -> list[Span]:
    return alternating(text, _ROUND, "\\(") + alternating(text, _SQUARE, "\\[") if "\\" in text else []


def templates(text: str) -> list[Span]:
    return [(a, b) for a, b in balanced(text, _BRACES, "{{") if b - a > 4 and not _LONE_BRACE.search(text, a, b)] if "{{" in text else []


#: Constructs of any length and depth, found by linear scans.
SCANNERS = [("html", "comment", comments), ("html", "pre", preformatted), ("latex", "formula", display_formulas), ("wiki", "template", templates)]

HINT = re.compile(r"[<&\\$|{\[='`~#>*_+]|^[-:;]|\n[ \t]*[-:;]")
WORDS = re.compile(r"[^\W_]")

SAMPLE_ROWS = 3000  # rows from whose lines the weights are learned
ROWS = "chunk_id long, languages array<string>, clean string, structure array<struct<kind:string,start:int,end:int>>"

Found = tuple[int, int, str, str]


def constructs(text: str) -> list[Found]:
    """``(start, end, language, construct)``, in order of position.

    Code blocks hide what is inside them; so do formulas and comments. Other constructs may contain others.
    """
    if not HINT.search(text):
        return []
    spans: list[Found] = []
    for lang, kind, pattern in PATTERNS:
        spans += [(m.start(), m.end(), lang, kind) for m in pattern.finditer(text)]
    for lang, kind, scan in SCANNERS:
        spans += [(a, b, lang, kind) for a, b in scan(text)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    shields = [s for s in spans if s[3] in ("fence", "pre", "comment", "formula")] + [(m.start(), m.end(), "latex", "verbatim") for m in VERBATIM.finditer(text)]
    shields.sort()
    out: list[Found] = []
    k, until = 0, -1
    for s in spans:
        while k < len(shields) and shields[k][0] <= s[0]:
            if shields[k][0] >= until:  # a shield that starts within another is none
                shield, until = shields[k], shields[k][1]
            k += 1
        inside = s[0] < until and (s[0], s[1]) != (shield[0], shield[1])
        if not inside or shield[3] == "verbatim" and (s[0] == shield[0] or s[1] == shield[1]) and s[3] == "environment":
            out.append(s)
    return out


VERBATIM = re.compile(r"\\begin\s*\{(verbatim|lstlisting|minted)\}.*?\\end\s*\{\1\}", re.S)


def learn(texts: list[str]) -> dict[str, float]:
    """Weights of words and constructs: log odds of standing on a line with text against a line of markup alone."""
    content, frame = {"word": 1.0}, {"word": 1.0}
    for text in texts:
        found = constructs(text)
        at = 0
        for line in text.split("\n"):
            end = at + len(line)
            here = [kind for a, _, _, kind in found if at <= a <= end]
            rest = line
            for a, b, _, _ in found:
                if at <= a and b <= end:
                    rest = rest.replace(text[a:b], " ") if text[a:b].startswith("<") else rest
            words = len(WORDS.findall(rest))
            side = content if words >= 4 else frame
            side["word"] += words
            for kind in here:
                side[kind] = side.get(kind, 0.5) + 1
            at = end + 1
    total_c, total_f = sum(content.values()), sum(frame.values())
    weights = {}
    for kind in {*content, *frame}:
        odds = math.log(content.get(kind, 0.5) / total_c) - math.log(frame.get(kind, 0.5) / total_f)
        weights[kind] = max(0.2, odds) if kind == "word" else min(-0.2, odds)
    return weights


def region(text: str, found: list[Found], weights: dict[str, float]) -> tuple[int, int]:
    """The maximum-scoring subsequence of the words and constructs, as ``[start, end)`` of the text."""
    hidden, until = [], -1
    for a, b, _, kind in found:
        if kind in ("tag", "comment", "entity", "environment", "command", "nowiki") and a >= until:
            hidden.append((a, b))
            until = b
    words, k = [], 0
    for m in WORDS.finditer(text):
        while k < len(hidden) and hidden[k][1] <= m.start():
            k += 1
        if k == len(hidden) or m.start() < hidden[k][0]:
            words.append((m.start(), m.end(), weights.get("word", 1.0)))
    events = sorted([(a, b, weights.get(kind, -0.5)) for a, b, _, kind in found if kind not in ("formula", "fence", "pre")] + words)
    best, total, start, span = 0.0, 0.0, 0, (0, len(text))
    for a, b, w in events:
        if total <= 0:
            total, start = 0.0, a
        total += w
        if total > best:
            best, span = total, (start, b)
    return span


class Clean:
    """Collects plain text and the spans of what is kept as structure."""

    def __init__(self) -> None:
        self.kept: list[tuple[str, str]] = []

    def keep(self, kind: str, text: str) -> str:
        self.kept.append((kind, text))
        return f"\x01{len(self.kept) - 1}\x02"

    def finish(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        spans: list[tuple[str, int, int]] = []

        def put(text: str, at: int) -> str:
            out, last, size = [], 0, at
            for m in re.finditer("\x01(\\d+)\x02", text):
                out.append(text[last : m.start()])
                size += m.start() - last
                kind, inner = self.kept[int(m[1])]
                slot = len(spans)
                spans.append((kind, size, size))
                inner = put(inner, size)
                out.append(inner)
                spans[slot] = (kind, size, size + len(inner))
                size += len(inner)
                last = m.end()
            out.append(text[last:])
            return "".join(out)

        return put(text, 0), spans


def _code(body: str) -> str:
    return "\n".join("    " + line.rstrip("\r") for line in body.strip("\r\n").split("\n"))


def _rows(rows: list[list[str]]) -> str:
    return "\n".join("\t".join(" ".join(c.split()) for c in row) for row in rows if any(c.strip() for c in row))


_STRIP_TAG = re.compile(_TAG, re.I | re.S)


def replaced(text: str, spans: list[Span], put: Callable[[str], str]) -> str:
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= last:
            out += [text[last:a], put(text[a:b])]
            last = b
    return "".join(out) + text[last:]


def until_done(pattern: str, put: str, text: str) -> str:
    """Replaces innermost constructs until there are none, as many times as they are nested."""
    while (now := re.sub(pattern, put, text)) != text:
        text = now
    return text


def convert(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Text without markup: ``(clean, structure)``; structure spans are headings, list items, code, tables and formulas."""
    c = Clean()
    sub = re.sub
    text = text.replace("\x01", "").replace("\x02", "")
    text = replaced(text, comments(text), lambda x: x[9:-3] if x.startswith("<![") else "")
    text = sub(r"<!DOCTYPE[^>]*>", "", text, flags=re.I)
    # code
    text = sub(r"(?m)^[ \t]*(`{3,}|~{3,})[^`~\n]*\n(.*?)^[ \t]*\1[`~]*[ \t]*\r?$", lambda m: c.keep("code", _code(m[2])), text, flags=re.S)
    text = replaced(text, preformatted(text), lambda x: "\n" + c.keep("code", _code(html.unescape(sub(r"^<pre\b[^>]*>|</pre\s*>$|</?code[^>]*>", "", x, flags=re.I)))) + "\n")
    text = sub(r"\\begin\s*\{(verbatim|lstlisting|minted)\}(.*?)\\end\s*\{\1\}", lambda m: c.keep("code", _code(m[2])), text, flags=re.S)
    text = sub(r"(?m)^[ \t]*(?:`{3,}|~{3,})[^`~\n]*$", "", text)
    # formulas
    formula = lambda x: c.keep("formula", sub(r"^(?:\$\$?|\\\(|\\\[)\s*|\s*(?:\$\$?|\\\)|\\\])$", "", x))
    text = replaced(text, display_formulas(text), formula)
    text = PATTERNS[[k for _, k, _ in PATTERNS].index("formula")][2].sub(lambda m: formula(m[0]), text)
    text = sub(r"<math\b[^>]*>(.*?)</math>", lambda m: c.keep("formula", m[1].strip()), text, flags=re.S)
    # tables
    text = sub(r"<table\b[^>]*>(.*?)</table\s*>", lambda m: "\n" + c.keep("table", _rows([[_STRIP_TAG.sub("", x) for x in re.findall(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]|$)", r, re.S | re.I)] for r in re.split(r"<tr\b[^>]*>", m[1], flags=re.I)])) + "\n", text, flags=re.S | re.I)
    text = sub(r"(?m)^\s*\{\|[^\n]*\n(.*?)^\s*\|\}", lambda m: c.keep("table", _rows([re.split(r"\|\||!!", sub(r"(?m)^\s*[|!]\+?", "||", r).strip("| \n")) for r in re.split(r"(?m)^\s*\|-[^\n]*$", m[1])])), text, flags=re.S)
    text = sub(r"\\begin\s*\{tabular\*?\}(?:\{[^{}]*\})?(.*?)\\end\s*\{tabular\*?\}", lambda m: c.keep("table", _rows([r.replace("\\hline", "").split("&") for r in re.split(r"\\\\", m[1])])), text, flags=re.S)
    text = sub(r"(?m)((?:^[ \t]*\|.*\|[ \t]*\r?\n?)+)", lambda m: c.keep("table", _rows([r.strip().strip("|").split("|") for r in m[1].splitlines() if not re.fullmatch(r"[\s|:\-]+", r)])) + "\n", text)
    # headings
    head = lambda x: "\n" + c.keep("heading", x.strip()) + "\n"
    text = sub(r"(?m)^[﻿]? {0,3}#{1,6}[ \t　]+(.*?)[ \t]*#*[ \t]*\r?$", lambda m: c.keep("heading", m[1].strip()), text)
    text = sub(r"(?m)^([^\n]*\S)[ \t]*\r?\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*\r?$", lambda m: c.keep("heading", m[1].strip()), text)
    text = sub(r"(?m)^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*\r?$", lambda m: c.keep("heading", m[2].strip()), text)
    text = sub(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: head(_STRIP_TAG.sub("", m[2])), text, flags=re.S | re.I)
    text = sub(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title|caption)\*?\{([^{}\n]*)\}", lambda m: c.keep("heading", m[1].strip()), text)
    # lists
    text = sub(r"<li\b[^>]*>(.*?)(?=<li\b|</li|</[uo]l|$)", lambda m: "\n" + c.keep("item", "• " + " ".join(m[1].split())), text, flags=re.S | re.I)
    text = sub(r"(?m)^[ \t]*\\item\b[ \t]*(.*)$", lambda m: c.keep("item", "• " + m[1].strip()), text)
    text = sub(r"(?m)^[ \t]*[-+*][ \t]+(?!\d+[ \t]*\r?$)(?=[^\s*_-])(.*)$", lambda m: c.keep("item", "• " + m[1].strip()), text)
    text = sub(r"(?m)^[;:]+[ \t]+(\S.*)$", lambda m: c.keep("item", "• " + m[1].strip()), text)
    inline = lambda x: _inline(c, x)
    c.kept = [(kind, x if kind in ("code", "formula") else inline(x)) for kind, x in c.kept]
    clean, spans = c.finish(inline(text))
    lines = re.sub(r"(?<![ \t])[ \t]+(?=\r?\n)", "", clean)
    if lines != clean or "\n\n\n" in clean:  # squeezing moves the spans, so it is done by mapping each end
        kept_at, out, blank = [0], [], 0
        for k, ch in enumerate(clean):
            blank = blank + 1 if ch == "\n" else 0 if not ch.isspace() else blank
            if blank <= 2:
                out.append(ch)
            kept_at.append(len(out))
        spans = [(kind, kept_at[a], kept_at[b]) for kind, a, b in spans]
        clean = "".join(out)
    return clean, spans


def _inline(c: Clean, x: str) -> str:
    """Inline constructs to text: emphasis, links, images, footnote marks, quotes, tags, templates, entities, commands."""
    if not re.search(r"[<&\\{\[*_~`'>]", x):
        return x
    sub = re.sub
    x = sub(r"!\[([^\[\]]*)\]\([^()\s]*(?:\s[^()\n]*)?\)", r"\1", x)
    x = sub(r"\[([^\[\]]*)\]\((?:[^()\s]|\n)+(?:\s[^()\n]*)?\)", r"\1", x)
    x = sub(r"\[\^[^\[\]\s]+\]:?", "", x)
    x = sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", x)
    x = sub(r"\[(?:https?|ftp)://[^\s\]]+\s*([^\]]*)\]", r"\1", x)
    x = until_done(r"\{\{(?:[^{}|]*\|)*?(?:页=[^{}|]*)?([^{}|=]*)(?:\|[^{}|=]*=[^{}|]*)*\}\}", r"\1", x)
    x = sub(r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?", "", x)
    x = sub(r"\\(?:label|ref|eqref|cite[pt]?|vspace|hspace|includegraphics|input)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", x)
    x = until_done(r"\\(?:footnote|emph|text[a-z]{2}|textnormal|underline|uline|mbox|hbox|fbox|url)\*?\{([^{}]*)\}", r"\1", x)
    x = sub(r"\{\\(?:it|bf|em|tt|sc|rm|sl)\b\s*([^{}]*)\}", r"\1", x)
    x = sub(r"(?<![A-Za-z]:)\\(?:item|maketitle|noindent|newpage|clearpage|centering|hline|par|bigskip|medskip|smallskip|quad|qquad)(?![A-Za-z])", "", x)
    x = sub(r"\*\*\*([^*\n]+)\*\*\*|\*\*([^*\n]+)\*\*|(?<!_)__([^\n]+?)__(?!_)", lambda m: m[1] or m[2] or m[3], x)
    x = sub(r"(?<![*\d\\])\*(?=[^\s*])([^*\n]+)(?:(?<=[^\s*\d])\*(?!\*)|(?<=\d)\*(?![*\d]))|(?<=\d)\*(?=[^\s*\d])([^*\n]+)(?<=[^\s*])\*(?![*\d])", lambda m: m[1] or m[2], x)
    x = sub(r"(?<!~)~~(?=[^\s~])([^~\n]+)~~(?!~)", r"\1", x)
    x = sub(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", lambda m: c.keep("code", m[1]), x)
    x = sub(r"'''''([^'\n]+)'''''|'''([^'\n]+)'''|''([^'\n]+)''", lambda m: m[1] or m[2] or m[3], x)
    x = sub(r"(?m)^ {0,3}>[ \t]?(?!\s*\d+[，,])", "", x)
    x = sub(r"<br\s*/?>", "\n", x, flags=re.I)
    x = sub(r"</(?:p|div|ul|ol|tr|blockquote|section)\s*>", "\n", x, flags=re.I)
    x = _STRIP_TAG.sub("", x)
    x = sub(r"</?(?:nowiki|ref|references|gallery|syntaxhighlight|poem)\b[^<>]*>", "", x)
    return html.unescape(x) if "&" in x else x


def cleaned(chunks: DataFrame, weights: dict[str, float], convert_text: bool = True) -> DataFrame:
    """``chunk_id, languages, clean, structure`` of every chunk with at least one construct.

    ``languages`` lists the markup languages of the target in a fixed order. Null and empty targets have none;
    repeated rows come out each for itself. Without ``convert_text`` clean and structure are null.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, languages, texts, spans = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text or not (found := constructs(text)):
                continue
            a, b = region(text, found, weights)
            have = {lang for _, _, lang, _ in found}
            keep.append(k)
            languages.append([x for x in ("html", "markdown", "wiki", "latex") if x in have])
            if convert_text:
                # a construct that the region's end cuts through, and marks and words that belong to structure, stay
                low = max([0] + [e for s, e, _, what in found if e <= a and what in ("comment", "tag")])
                high = min([len(text)] + [s for s, e, _, what in found if s >= b and what in ("comment", "tag")])
                clean, kept = convert(text[low:high] if not STRUCTURAL.search(text[:low] + text[high:]) else text)
                texts.append(clean)
                spans.append([{"kind": w, "start": s, "end": e} for w, s, e in kept])
            else:
                texts.append(None)
                spans.append(None)
        if not keep:
            return None
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(languages, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(spans, kind)], ["chunk_id", "languages", "clean", "structure"])

    return arrow_map(chunks.select(F.col("chunk_id").cast("long"), "target"), rows, ROWS)


STRUCTURAL = re.compile(r"</?(?:h[1-6]|li|ul|ol|table|tr|td|th|pre|code)\b", re.I)


def weights_of(chunks: DataFrame) -> dict[str, float]:
    """Weights learned on about SAMPLE_ROWS rows."""
    return learn(sample(chunks, "chunk_id", "target", SAMPLE_ROWS))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "your_markdown", "chunk_id", "target")
    return cleaned(spread(chunks), weights_of(chunks))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and markup language whose constructs the conversion removes."""
    return clean_text(spark, sf_dir).select("chunk_id", F.explode("languages").alias("markup"))
