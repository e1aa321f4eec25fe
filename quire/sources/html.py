"""Paragraphs of HTML, and HTML from mail archives."""

from __future__ import annotations

import html
import re
from email import message_from_bytes
from email.message import Message

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.I | re.S)
DROP = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|tbody|section|article|blockquote|pre|td|th|hr)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]+>")


def _plain(markup: str) -> list[str]:
    body = html.unescape(TAG.sub("", BLOCK.sub("\n", markup)))
    return [x for line in body.split("\n") if (x := " ".join(line.split()))]


def paragraphs(markup: str) -> list[tuple[str, int]]:
    """``(text, heading level)`` in order; the level is 0 for what is no heading. Blank paragraphs are left out."""
    out: list[tuple[str, int]] = []
    at = 0
    markup = DROP.sub("", markup)
    for m in HEADING.finditer(markup):
        out += [(x, 0) for x in _plain(markup[at : m.start()])]
        if title := " ".join(_plain(m[2])):
            out.append((title, int(m[1])))
        at = m.end()
    return out + [(x, 0) for x in _plain(markup[at:])]


def decoded(data: bytes, charset: str | None) -> str:
    """Bytes in the charset they name, or else the first that reads them: UTF-8, GB18030, Big5."""
    for name in filter(None, (charset, "utf-8", "gb18030", "big5")):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def mail_html(data: bytes) -> str:
    """The HTML part of a mail archive, transfer encoding and charset undone; other bytes are read as HTML."""
    if b"Content-Type" not in data[:4096]:
        return decoded(data, None)
    message: Message = message_from_bytes(data)
    parts = [p for p in message.walk() if p.get_content_type() in ("text/html", "application/xhtml+xml")] or [p for p in message.walk() if p.get_content_maintype() == "text"]
    if not parts:
        return ""
    body = parts[0].get_payload(decode=True) or b""
    named = re.search(rb"charset=[\"']?([\w-]+)", body[:2048])
    return decoded(body, parts[0].get_content_charset() or (named[1].decode() if named else None))


def page_paragraphs(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, pos, text, heading_level`` of every page; null and blank pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, n, text, level) for k, body in zip(*(c.to_pylist() for c in batch.columns)) for n, (text, level) in enumerate(paragraphs(body or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32()))], [key, "pos", "text", "heading_level"])

    return pages.select(F.col(key), F.col(markup)).mapInArrow(run, f"{key} {kind}, pos int, text string, heading_level int")


def to_markdown(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, text``: pages as Markdown, headings with their marks and paragraphs apart; pages without a paragraph are left out."""
    p = page_paragraphs(pages, key, markup)
    line = F.concat(F.when(F.col("heading_level") > 0, F.concat(F.repeat(F.lit("#"), "heading_level"), F.lit(" "))).otherwise(""), "text")
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return g.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("text"))
