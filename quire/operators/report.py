"""Reports: filters by type, similarity, text and index lists; cards; chapters; HTML of an alignment or of findings."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.similarity import opcodes


def index_filter(spec: str, c: Column) -> Column:
    """``1,2,5-20,80-`` as a condition; an empty list selects all; what can't be read selects nothing of its own."""
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        if m := re.fullmatch(r"(\d+)(-)?(\d+)?", p):
            low, dash, high = int(m[1]), m[2], m[3]
            out = out | ((c == low) if not dash else c.between(low, int(high)) if high else c >= low)
    return out


def select(alignment: DataFrame, types: list[str] | None = None, low: float = 0.0, high: float = 1.0, text: str = "", indices: str = "") -> DataFrame:
    """Rows (type, similarity, a, b, seq) that a report's filters leave."""
    a = alignment.where(F.col("similarity").between(low, high))
    if types:
        a = a.where(F.col("type").isin(types))
    if text:
        a = a.where(F.lower(F.coalesce("a", F.lit(""))).contains(text.lower()) | F.lower(F.coalesce("b", F.lit(""))).contains(text.lower()))
    return a.where(index_filter(indices, F.col("seq")))


def cards(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of each document in all and by severity."""
    return findings.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")))


def by_chapter(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, chapter, first_pos, findings``: findings by chapter in the order of the text; those without one go last."""
    g = findings.groupBy(key, F.coalesce("chapter", F.lit("结构诊断")).alias("chapter")).agg(F.min(F.when(F.col("chapter").isNotNull(), F.col("position"))).alias("first_pos"), F.count("*").alias("findings"))
    return g.orderBy(key, F.col("first_pos").asc_nulls_last())


def alignment_html(rows: list, title: str) -> str:
    """An alignment's rows as a page; everything that comes from texts is escaped."""
    cells = "".join(f'<tr class="{html.escape(r["type"])}"><td>{r["seq"]}</td><td>{html.escape(r["type"])}</td><td>{html.escape(r["a"] or "")}</td><td>{html.escape(r["b"] or "")}</td><td>{r["similarity"]:.3f}</td></tr>' for r in rows)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{cells}</table></body></html>'


def tree_json(nodes: list) -> list[dict]:
    """The nested form of heading rows (node_id, parent_id, ...), in order."""
    made = {r["node_id"]: {**r.asDict(), "children": []} for r in nodes}
    roots = []
    for n in sorted(made):
        (made[made[n]["parent_id"]]["children"] if made[n]["parent_id"] >= 0 else roots).append(made[n])
    return roots


@arrow_udf(T.StringType())
def diff_html(a: pa.Array, b: pa.Array) -> pa.Array:
    """Two texts as one line of HTML, what was taken out and put in marked; runs of blank lines count as one. Null where either is null."""

    def one(x: str, y: str) -> str:
        x, y = (re.sub(r"\n\s*\n+", "\n", t) for t in (x, y))
        out = []
        for tag, a1, a2, b1, b2 in opcodes(x, y):
            if tag == "equal":
                out.append(html.escape(x[a1:a2]))
            else:
                out += [f"<del>{html.escape(x[a1:a2])}</del>"] * (a2 > a1) + [f"<ins>{html.escape(y[b1:b2])}</ins>"] * (b2 > b1)
        return "".join(out).replace("\n", "<br>")

    return pa.array([None if x is None or y is None else one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())


def _escaped(c: Column) -> Column:
    for ch, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(ch), F.lit(f"&{name};"))
    return c


def _clipped(c: Column, size: int) -> Column:
    c = F.coalesce(c, F.lit(""))
    return _escaped(F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c))


def finding_rows(findings: DataFrame) -> DataFrame:
    """``row``: each finding (severity, type, original, suggested, reason) as a row of a table, texts cut to 80 and 120 characters."""
    cell = lambda c, n: F.concat(F.lit("<td>"), _clipped(F.col(c), n), F.lit("</td>"))
    head = F.concat(F.lit('<tr class="'), _escaped(F.coalesce("severity", F.lit("info"))), F.lit('">'))
    return findings.select("*", F.concat(head, cell("type", 80), cell("original", 80), cell("suggested", 80), cell("reason", 120), F.lit("</tr>")).alias("row"))


def issue_items(findings: DataFrame) -> DataFrame:
    """``item``: each finding (original, suggested, reason, ratio) as a list item, texts cut to 300 and 600 characters; a place found by similarity says so."""
    note = F.when(F.col("ratio") < 80, F.concat(F.lit("<em>匹配率 "), F.format_number("ratio", 1), F.lit("</em>"))).when(F.col("ratio") < 100, F.lit("<em>近似</em>")).otherwise("")
    return findings.select("*", F.concat(F.lit("<li><del>"), _clipped(F.col("original"), 300), F.lit("</del> <ins>"), _clipped(F.col("suggested"), 300), F.lit("</ins> "), F.coalesce(note, F.lit("")), F.lit("<p>"), _clipped(F.col("reason"), 600), F.lit("</p></li>")).alias("item"))


def annotation(tag: Column, original: Column, suggested: Column, category: Column, reasons: Column, evidence: Column) -> Column:
    """The lines of a note on a page: tag and text, what it should be, category, distinct reasons, and evidence (title, url, accessed_at)."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    said = F.array_distinct(F.filter(F.transform(reasons, lambda x: F.trim(x)), lambda x: (x != "") & ~x.eqNullSafe(suggested)))
    known = F.filter(evidence, lambda e: filled(F.coalesce(filled(e["title"]), e["url"])).isNotNull())
    source = F.transform(known, lambda e: F.concat_ws("\n", F.concat(F.lit("依据："), F.coalesce(filled(e["title"]), F.trim(e["url"])), F.coalesce(F.concat(F.lit("（访问于 "), filled(e["accessed_at"]), F.lit("）")), F.lit(""))), F.when(filled(e["title"]).isNotNull() & ~filled(e["title"]).eqNullSafe(filled(e["url"])), filled(e["url"]))))
    return F.concat_ws(
        "\n",
        F.concat(tag, F.lit(" "), F.coalesce(original, F.lit(""))),
        F.when((suggested != "") & ~suggested.eqNullSafe(original), F.concat(F.lit("→ "), suggested)),
        F.concat(F.lit("分类："), filled(category)),
        F.transform(F.coalesce(said, F.array().cast("array<string>")), lambda x: F.concat(F.lit("理由："), x)),
        F.coalesce(source, F.array().cast("array<string>")),
    )


#: A page's own filter by type: rows of a type are hidden while its box is off.
_FILTER = "<p>{boxes}</p><script>document.querySelectorAll('input').forEach(b=>b.onchange=()=>document.querySelectorAll('tr.'+b.value).forEach(r=>r.hidden=!b.checked))</script>"


def alignment_pages(alignment: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, page``: one page of HTML for each pair of an alignment (key, seq, type, a, b, similarity), with boxes that hide types."""
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit('<tr class="'), _escaped(F.col("type")), F.lit('">'), cell(F.col("seq").cast("string")), cell(F.col("type")), cell(F.col("a")), cell(F.col("b")), cell(F.format_number("similarity", 3)), F.lit("</tr>"))
    g = alignment.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("rows"), F.array_sort(F.collect_set("type")).alias("types"))
    boxes = F.array_join(F.transform("types", lambda t: F.concat(F.lit('<label><input type="checkbox" checked value="'), _escaped(t), F.lit('">'), _escaped(t), F.lit("</label>"))), "")
    head, tail = _FILTER.split("{boxes}")
    body = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><table>'), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("</table>" + head), boxes, F.lit(tail + "</body></html>"))
    return g.select(key, body.alias("page"))


def finding_pages(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, page``: one page for each document, its findings (chapter, position, original, suggested, reason, ratio, severity) by chapter under cards of their number."""
    items = issue_items(findings.withColumn("chapter", F.coalesce("chapter", F.lit("结构诊断"))))
    first = F.min("position")
    part = items.groupBy(key, "chapter").agg(first.alias("at"), F.array_sort(F.collect_list(F.struct("position", "item"))).alias("items"))
    section = F.concat(F.lit("<h2>"), _escaped(F.col("chapter")), F.lit("</h2><ul>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</ul>"))
    body = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("chapter") == "结构诊断").alias("last"), "at", "chapter", section.alias("html")))).alias("parts"))
    counts = cards(findings, key)
    card = lambda c: F.concat(F.lit(f"<b>{c} "), F.col(c).cast("string"), F.lit("</b> "))
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><p>'), *(card(c) for c in ("total", "error", "warn", "info")), F.lit("</p>"), F.array_join(F.transform("parts", lambda x: x["html"]), ""), F.lit("</body></html>"))
    return body.join(counts, key).select(key, page.alias("page"))
