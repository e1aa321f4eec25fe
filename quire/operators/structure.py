"""Heading structure: numbered headings are scanned, put in a tree, and checked for level and numbering.

A document is one unit of work: its headings are few and depend on those before. Scanning reads a line at a time
through a cursor over normalized characters that remember where they came from.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import first_value

#: Fixed values.
LONG, SHORT = "一二三四五六七八九十百千零〇两壹贰叁肆伍陆柒捌玖拾", "一二三四五六七八九十百千零〇两"
SPECIAL = "前言|绪论|引言|序言|结语|结论|附录|后记|参考文献|致谢|注释|索引|后序"
ROMAN_SIGNS = dict(zip("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "I II III IV V VI VII VIII IX X XI XII".split()))


@dataclass(frozen=True)
class Rule:
    id: str
    level: int
    priority: int
    pattern: str
    order: tuple[str, ...]
    continuity: str  # strict, restart or none
    optional: bool
    children: tuple[str, ...] = ()
    everywhere: bool = True  # also on lines that are no headings


#: The kinds of numbered headings.
RULES = (
    Rule("part", 1, 105, rf"(?:第(?:(?P<cn>[{LONG}]+)|(?P<arabic>[0-9]+)|(?P<roman>[IVXLCDM]+))(?:部分|部|编|篇|卷|册)|(?:卷|部)(?:(?P<cn2>[{SHORT}]+)|(?P<roman2>[IVXLCDM]+)))", ("cn", "arabic", "roman"), "none", True, ("chapter", "section", "cn_item", "paren_cn", "ar_punct", "num_dot", "subsection", "special")),
    Rule("chapter", 1, 100, rf"第(?:(?P<cn>[{LONG}]+)|(?P<arabic>[0-9]+)|(?P<roman>[IVXLCDM]+))章", ("cn", "roman", "arabic"), "strict", False, ("section",)),
    Rule("section", 2, 90, rf"第(?:(?P<cn>[{LONG}]+)|(?P<arabic>[0-9]+)|(?P<roman>[IVXLCDM]+))节", ("cn", "arabic", "roman"), "strict", False, ("subsection",)),
    Rule("subsection", 3, 80, r"(?P<arabic>[0-9]+)\.(?=\D|$)", ("arabic",), "restart", True, everywhere=False),
    Rule("cn_item", 3, 79, rf"(?P<cn>[{SHORT}]+)、", ("cn",), "restart", True),
    Rule("paren_cn", 3, 78, rf"[（(](?P<cn>[{SHORT}]+)[）)]", ("cn",), "restart", True),
    Rule("ar_punct", 3, 77, r"(?P<arabic>[0-9]+)、", ("arabic",), "restart", True),
    Rule("num_dot", 3, 76, r"(?P<dots>[0-9]+(?:\.[0-9]+)+)(?=\D|$)", (), "none", True, everywhere=False),
    Rule("special", 1, 40, rf"(?:{SPECIAL})(?:[A-Za-z0-9一二三四五六七八九十百]+)?(?=$|[ \t　:：·、])", (), "none", True, everywhere=False),
)

BLANK = " \t　"
ATX = re.compile("﻿?(#{1,9})(?!#)")
FENCE = re.compile(r"[ \t]{0,3}(?:`{3,}|~{3,})")
SETEXT = re.compile(r"={3,}[ \t]*$")
#: What may stand before a number, whole or without brackets; which headings are found depends on exactly these.
OUTSIDE = re.compile("[（(【［「『《〈〔｛<\"'“”‘’`]|[-+*](?=[ \t　])|[ \t　]")
INSIDE = re.compile("[「『‘“”\"'`]|[-+*](?=[ \t　])|[ \t　]")
#: A decimal with a unit, or with a year before its point, is an amount or a date and no number of a heading.
AMOUNT = re.compile(r"\d+\.[ \t　]*\d+(?:\.\d+)?[ \t　]*(?:[亿億万萬千百%％]|元)(?:元|$|\D)")
WHOLE_AMOUNT = re.compile(r"\d+\.[ \t　]+\d+(?:\.\d+)?[ \t　]*[亿億万萬千百%％元]+[ \t　]*$")
YEAR = re.compile(r"(?:19|20)\d\d\.\d")


@dataclass
class Token:
    rule: Rule
    start: int
    end: int
    raw: str
    number: int | None
    system: str | None
    level: int
    heading: int | None
    line: int
    unit: str = ""


@dataclass
class Node:
    token: Token
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Diagnostic:
    kind: str
    message: str
    start: int
    end: int


def normalized(text: str) -> tuple[str, list[int]]:
    """A line in plain forms, and the place of each of its characters in the line (and one at the end)."""
    out, at = [], []
    for k, ch in enumerate(text):
        o = ord(ch)
        if ch == "節":
            new = "节"
        elif ch in ROMAN_SIGNS:
            new = ROMAN_SIGNS[ch]
        elif 0x2170 <= o <= 0x217B:
            new = ROMAN_SIGNS[chr(o - 16)]
        elif 0xFF10 <= o <= 0xFF19 or ch == "．" or 0xFF21 <= o <= 0xFF5A:
            new = chr(o - 0xFEE0)
        else:
            new = ch
        out.append(new)
        at += [k] * len(new)
    plain = re.sub(r"(?<=第)[ivxlcdm]+(?=[章节部编篇卷册])", lambda m: m[0].upper(), "".join(out))
    return plain, [*at, len(text)]


def read_number(rule: Rule, m: re.Match) -> tuple[int | None, str | None]:
    groups = {k.rstrip("2"): v for k, v in m.groupdict().items() if v}
    system = next((k for k in rule.order if k in groups), None)
    return first_value(groups, list(rule.order)), system


def line_tokens(content: str, rules: tuple[Rule, ...], heading: int | None, decorated: re.Pattern = OUTSIDE) -> list[tuple[Rule, re.Match]]:
    """The numbers that a line opens with: one, and as many deeper ones as follow it directly."""
    p = 0
    for _ in range(8):
        if not (m := decorated.match(content, p)):
            break
        p = m.end()
    found: list[tuple[Rule, re.Match]] = []
    while True:
        best = None
        for rule in rules:
            if (heading is None and not rule.everywhere) or not (m := re.compile(rule.pattern).match(content, p)):
                continue
            rest = content[m.end() :]
            if rule.id == "subsection" and WHOLE_AMOUNT.match(content, p):
                continue
            if rule.id == "num_dot" and (AMOUNT.match(content, p) or YEAR.match(content, p)):
                continue
            lead = rest[:1]
            opens_next = lead == "第" and any(re.match(r.pattern, rest) for r in rules if r.id in ("chapter", "section"))
            named = rule.id in ("chapter", "section")
            if named and (heading is None or found) and lead and lead not in BLANK and not opens_next:
                continue  # on a plain line, or behind another number, a word right after it is prose
            if found:
                above = found[-1][0]
                level, top = level_of(rule, m), level_of(*found[-1])
                if not (level > top or above.id == "part" and rule.id != "part"):
                    continue
            if best is None or (m.end(), rule.priority) > (best[1].end(), best[0].priority):
                best = (rule, m)
        if best is None:
            return found
        found.append(best)
        p = best[1].end()
        while p < len(content) and content[p] in BLANK:
            p += 1
        if content[p : p + 1] == "第" and re.match(r"第[0-9]+\.", content[p:]):
            p += 1


def level_of(rule: Rule, m: re.Match) -> int:
    return m["dots"].count(".") + 1 if rule.id == "num_dot" else rule.level


def scan(text: str, rules: tuple[Rule, ...] = RULES) -> list[Token]:
    """The numbers of all heading lines and of plain lines that open like headings; none inside fenced code."""
    lines = re.split("(?<=\n)", text)
    tokens: list[Token] = []
    at, fenced = 0, False
    for k, line in enumerate(lines):
        body = line.rstrip("\r\n")
        start, at = at, at + len(line)
        if FENCE.match(body):
            fenced = not fenced
            continue
        if fenced or not body.strip():
            continue
        if m := ATX.match(body):
            heading, skip = len(m[1]), m.end()
        elif body[:1] in BLANK and body.lstrip(BLANK).startswith("#"):
            continue
        else:
            heading, skip = (1 if k + 1 < len(lines) and SETEXT.match(lines[k + 1].rstrip("\r\n")) else None), 0
            if SETEXT.match(body):
                continue
        content, back = normalized(body[skip:])
        got = line_tokens(content, rules, heading)
        if not got or got[0][0].id != "part":
            bracketed = line_tokens(content, tuple(r for r in rules if r.id == "paren_cn"), heading, INSIDE)
            got = bracketed or got
        for rule, m in got:
            low, high = start + skip + back[m.start()], start + skip + back[m.end()]
            number, system = read_number(rule, m)
            unit = re.sub(r".*(部分|部|编|篇|卷|册).*", r"\1", m[0]) if rule.id == "part" else ""
            tokens.append(Token(rule, low, high, text[low:high], number, system, level_of(rule, m), heading, k, unit))
    return tokens


def overlaps(tokens: list[Token]) -> tuple[list[Token], list[Diagnostic]]:
    """Of chains of overlapping tokens the best by priority, length and start; the others are told."""
    kept, lost, chain, far = [], [], [], -1

    def settle() -> None:
        if chain:
            best = min(chain, key=lambda t: (-t.rule.priority, t.start - t.end, t.start))
            kept.append(best)
            lost.extend(Diagnostic("overlap_discard", f"{t.raw} 与 {best.raw} 重叠", t.start, t.end) for t in chain if t is not best)

    for t in sorted(tokens, key=lambda t: (t.start, -t.rule.priority, t.start - t.end)):
        if t.start >= far:
            settle()
            chain = []
        chain.append(t)
        far = max(far, t.end)
    settle()
    return kept, lost


def build(tokens: list[Token]) -> list[Node]:
    """All nodes in order. A part takes in what follows it until the next part; a part named again goes on."""
    nodes: list[Node] = []
    stack: list[Node] = []
    for t in tokens:
        if t.rule.id == "part":
            open_part = next((n for n in stack if n.token.rule.id == "part"), None)
            if open_part and (open_part.token.number, open_part.token.unit) == (t.number, t.unit) and t.number is not None:
                del stack[stack.index(open_part) + 1 :]
                open_part.token = open_part.token if open_part.token.line == t.line else Token(**{**vars(open_part.token), "line": t.line})
                continue
        while stack and not _holds(stack[-1], t):
            stack.pop()
        node = Node(t, stack[-1] if stack else None)
        if stack:
            stack[-1].children.append(node)
        nodes.append(node)
        stack.append(node)
    return nodes


def _holds(n: Node, t: Token) -> bool:
    u = n.token
    if u.line == t.line:
        return t.level > u.level or u.rule.id == "part"
    if u.rule.id == "part":
        return t.rule.id != "part"
    if u.heading is not None and t.heading is not None and u.heading != t.heading:
        return t.heading > u.heading
    return t.level > u.level and (u.heading is None or t.heading is None)


def check_levels(nodes: list[Node]) -> Iterator[Diagnostic]:
    """Roots that lack what stands above them, and children that skip a level or stand no deeper than their parent."""
    shallow = min((n.token.rule.level for n in nodes), default=0)
    all_levels = min(shallow, 1)
    for n in nodes:
        t = n.token
        if n.parent is None:
            if not t.rule.optional and t.level > all_levels:
                yield Diagnostic("hierarchy_gap", f"{t.raw} 之上没有更高的层级", t.start, t.end)
            continue
        u = n.parent.token
        if u.rule.id == "part" or u.line == t.line:
            continue
        if u.heading is not None and t.heading is not None:
            step = t.heading - u.heading
        elif t.rule.id in u.rule.children or t.rule.optional:
            continue
        else:
            step = t.level - u.level
        if step > 1:
            yield Diagnostic("hierarchy_gap", f"{u.raw} 之下直接出现 {t.raw}", t.start, t.end)
        elif step <= 0:
            yield Diagnostic("level_mismatch", f"{t.raw} 不低于 {u.raw}", t.start, t.end)


def check_numbers(nodes: list[Node]) -> Iterator[Diagnostic]:
    """Numbers within each parent and kind: strictly upward, or upward with restarts at one.

    A number that can't be read is missing, and so is a lone X among numbers of another system. A change of the
    system starts anew. A chapter that is named again on a line with a section goes on if the one before had one,
    and its sections are compared across the lines.
    """
    groups: dict[tuple[int, str], list[Node]] = {}
    leader: dict[int, int] = {}  # a chapter that goes on stands for the first of its name
    for n in nodes:
        above = n.parent
        groups.setdefault((leader.get(id(above), id(above)) if above else 0, n.token.rule.id), []).append(n)
        if n.token.rule.continuity == "strict":
            mates = groups[(leader.get(id(above), id(above)) if above else 0, n.token.rule.id)]
            if len(mates) > 1 and _goes_on(mates[-2], n, nodes):
                leader[id(n)] = leader.get(id(mates[-2]), id(mates[-2]))
    for (_, _), mates in groups.items():
        rule = mates[0].token.rule
        if rule.continuity == "none":
            continue
        systems = {m.token.system for m in mates}
        last: Node | None = None
        for m in mates:
            t = m.token
            lone = t.system == "roman" and re.search("X", t.raw) and t.number == 10 and len(systems) > 1 and sum(x.token.system == "roman" for x in mates) == 1
            if t.number is None or lone:
                yield Diagnostic("number_missing", f"{t.raw} 没有可用的编号", t.start, t.end)
                continue
            if last and last.token.system == t.system:
                was = last.token.number
                goes = rule.continuity == "strict" and t.number == was and _goes_on(last, m, nodes)
                if not (t.number == was + 1 or goes or rule.continuity == "restart" and t.number == 1):
                    yield Diagnostic("continuity_error", f"{was} → {t.number}", t.start, t.end)
            last = m


def _goes_on(a: Node, b: Node, nodes: list[Node]) -> bool:
    """Whether b names the same chapter again, both with a section on their line."""
    with_section = lambda n: any(c.token.line == n.token.line for c in n.children) or any(x.token.line == n.token.line and x.token.level > n.token.level for x in nodes)
    return a.token.number is not None and a.token.number == b.token.number and a.token.system == b.token.system and a.token.line != b.token.line and with_section(a) and with_section(b)


def check(text: str, rules: tuple[Rule, ...] = RULES) -> tuple[list[Node], list[Diagnostic]]:
    tokens, lost = overlaps(scan(text, rules))
    nodes = build(tokens)
    return nodes, [*lost, *check_levels(nodes), *check_numbers(nodes)]


def enabled(rules: list[dict]) -> tuple[Rule, ...]:
    """Rules from their JSON form: those switched off are dropped, the rest sorted by level and priority."""
    names = {"strict_increase": "strict", "increase_or_restart": "restart"}
    out = [
        Rule(r["id"], int(r["level"]), int(r.get("priority", 0)), r["pattern"], tuple(r.get("numbering", {}).get("normalize", ())), names.get(r.get("numbering", {}).get("continuity"), "none"), bool(r.get("optional", False)), tuple(r.get("children", ())), r.get("everywhere", True))
        for r in rules
        if r.get("enabled", True)
    ]
    for r in out:
        re.compile(r.pattern)
    return tuple(sorted(out, key=lambda r: (r.level, -r.priority)))


NODES = "node_id int, parent_id int, depth int, rule_id string, raw_text string, number_value long, level int, heading_level int, line_no int, start_pos int, end_pos int"
DIAGNOSTICS = "kind string, message string, start_pos int, end_pos int"


def _per_text(docs: DataFrame, key: str, text: str, rows, schema: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    full = f"{key} {kind}, {schema}"

    def run(batches):
        for batch in batches:
            keys, cols = [], [[] for _ in schema.split(", ")]
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows(body or ""):
                    keys.append(k)
                    for col, v in zip(cols, row):
                        col.append(v)
            types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, types[x.split()[1]]) for c, x in zip(cols, schema.split(", ")))], [key, *(x.split()[0] for x in schema.split(", "))])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, full)


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The heading tree as rows: ``key, node_id, parent_id, depth, rule_id, raw_text, number_value, level, ...``; roots have parent -1."""

    def rows(body: str):
        nodes, _ = check(body)
        number = {id(n): k for k, n in enumerate(nodes)}
        depth: dict[int, int] = {}
        for k, n in enumerate(nodes):
            depth[id(n)] = depth[id(n.parent)] + 1 if n.parent else 0
            t = n.token
            yield k, number[id(n.parent)] if n.parent else -1, depth[id(n)], t.rule.id, t.raw, t.number, t.level, t.heading, t.line + 1, t.start, t.end

    return _per_text(docs, key, text, rows, NODES)


def diagnostics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, message, start_pos, end_pos`` of overlaps, level and numbering faults."""
    return _per_text(docs, key, text, lambda body: ((d.kind, d.message, d.start, d.end) for d in check(body)[1]), DIAGNOSTICS)


def rendered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, json, html``: the heading tree of each text, nested, as JSON and as lists with an anchor for each heading. Texts without a heading are left out."""

    def rows(body: str):
        nodes, _ = check(body)
        if not nodes:
            return
        made = {id(n): {"rule": n.token.rule.id, "raw": n.token.raw, "number": n.token.number, "level": n.token.level, "line": n.token.line + 1, "children": []} for n in nodes}
        for n in nodes:
            if n.parent:
                made[id(n.parent)]["children"].append(made[id(n)])

        def listed(some: list[dict]) -> str:
            return "<ul>" + "".join(f'<li id="h{x["line"]}-{x["rule"]}">{html.escape(x["raw"])}{listed(x["children"]) if x["children"] else ""}</li>' for x in some) + "</ul>"

        roots = [made[id(n)] for n in nodes if not n.parent]
        yield json.dumps(roots, ensure_ascii=False), listed(roots)

    return _per_text(docs, key, text, rows, "json string, html string")
