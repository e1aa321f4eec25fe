"""Writing edits back into Word documents as tracked changes, or as comments where an edit can't be placed safely."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import opcodes
from ..sources.docx import RELS, W, accepted_text, body_paragraphs

XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
COMMENTS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
NAMESPACES = {"w": W[1:-1], "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
MIN_ANCHOR, MAX_ANCHOR = 6, 30


@dataclass
class Edit:
    location: str
    current: str
    suggested: str
    note: str = ""
    comment_only: bool = False


def anchor(text: str, at: int, size: int) -> str | None:
    """The stretch around a place that occurs once in the text, grown evenly to both sides; None if none is short enough."""
    low, high = at, at + size
    while high - low <= max(MAX_ANCHOR, size):
        if high - low >= min(MIN_ANCHOR, len(text)) and text.count(text[low:high]) == 1:
            return text[low:high]
        if low == 0 and high == len(text):
            return None
        low, high = max(0, low - 1), min(len(text), high + 1)
    return None


def _direct_runs(p: ElementTree.Element) -> list[tuple[ElementTree.Element, str]]:
    """Runs that lie in the paragraph itself and hold plain text only; others can't be edited safely."""
    out = []
    for run in p:
        if run.tag == W + "r":
            inner = [x for x in run if x.tag != W + "rPr"]
            if inner and all(x.tag == W + "t" for x in inner):
                out.append((run, "".join(x.text or "" for x in inner)))
    return out


def _run_like(run: ElementTree.Element, text: str, deleted: bool = False) -> ElementTree.Element:
    new = ElementTree.Element(W + "r")
    if (style := run.find(W + "rPr")) is not None:
        new.append(copy.deepcopy(style))
    t = ElementTree.SubElement(new, W + ("delText" if deleted else "t"))
    t.text = text
    t.set(XML_SPACE, "preserve")
    return new


def track(p: ElementTree.Element, current: str, suggested: str, ids: list[int], author: str, date: str) -> bool:
    """Puts the change between two texts into a paragraph; False where the text isn't found once within plain runs."""
    runs = _direct_runs(p)
    whole = "".join(t for _, t in runs)
    if not current or accepted_text(p).count(current) != 1 or whole.count(current) != 1:
        return False
    at = whole.find(current)
    pos = 0
    inside = []
    for run, text in runs:
        if pos < at + len(current) and pos + len(text) > at:
            inside.append((run, text, pos))
        pos += len(text)
    children = list(p)
    places = [children.index(r) for r, _, _ in inside]
    if not places or places != list(range(places[0], places[-1] + 1)):
        return False  # something else lies between the runs
    first = inside[0][2]
    stretch = "".join(t for _, t, _ in inside)
    owner = [run for run, text, _ in inside for _ in text]
    low = at - first

    def pieces(a: int, b: int) -> Iterable[tuple[ElementTree.Element, str]]:
        k = a
        while k < b:
            j = k
            while j < b and owner[j] is owner[k]:
                j += 1
            yield owner[k], stretch[k:j]
            k = j

    def mark(tag: str, content: list[ElementTree.Element]) -> ElementTree.Element:
        ids[0] += 1
        m = ElementTree.Element(W + tag, {W + "id": str(ids[0]), W + "author": author, W + "date": date})
        m.extend(content)
        return m

    new = [_run_like(r, t) for r, t in pieces(0, low)]
    for tag, a1, a2, b1, b2 in opcodes(current, suggested):
        if tag == "equal":
            new += [_run_like(r, t) for r, t in pieces(low + a1, low + a2)]
            continue
        if a2 > a1:
            new.append(mark("del", [_run_like(r, t, True) for r, t in pieces(low + a1, low + a2)]))
        if b2 > b1:
            new.append(mark("ins", [_run_like(owner[min(low + a1, len(owner) - 1)], suggested[b1:b2])]))
    new += [_run_like(r, t) for r, t in pieces(low + len(current), len(stretch))]
    for r, _, _ in inside:
        p.remove(r)
    for k, x in enumerate(new):
        p.insert(places[0] + k, x)
    return True


def comment(p: ElementTree.Element, number: int) -> None:
    """Anchors a comment over a paragraph."""
    at = 1 if len(p) and p[0].tag == W + "pPr" else 0
    p.insert(at, ElementTree.Element(W + "commentRangeStart", {W + "id": str(number)}))
    p.append(ElementTree.Element(W + "commentRangeEnd", {W + "id": str(number)}))
    run = ElementTree.SubElement(p, W + "r")
    ElementTree.SubElement(run, W + "commentReference", {W + "id": str(number)})


def apply(data: bytes, edits: list[Edit], author: str = "quire", date: str = "2000-01-01T00:00:00Z") -> tuple[bytes, list[str]]:
    """The document with the edits in it, and what became of each: tracked, commented, or the reason it was skipped.

    Paragraphs are numbered as ``docx.units`` numbers them; they are edited from back to front.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        parts = {n: archive.read(n) for n in archive.namelist()}
    for prefix, uri in re.findall(rb'xmlns:(\w+)="([^"]+)"', parts["word/document.xml"]):
        ElementTree.register_namespace(prefix.decode(), uri.decode())
    root = ElementTree.fromstring(parts["word/document.xml"])
    body = root.find(W + "body")
    units = [p for p, _ in body_paragraphs(body) if accepted_text(p).strip()]
    used = [int(x.get(W + "id")) for x in root.iter() if x.tag in (W + "ins", W + "del") and (x.get(W + "id") or "").isdigit()]
    ids, notes, fate = [max(used, default=0)], [], [""] * len(edits)
    old = ElementTree.fromstring(parts["word/comments.xml"]) if "word/comments.xml" in parts else ElementTree.Element(W + "comments")
    number = max([int(c.get(W + "id", -1)) for c in old], default=-1)
    place = [int(m[1]) if (m := re.search(r"P(\d+)", e.location or "")) else -1 for e in edits]
    for k in sorted(range(len(edits)), key=lambda k: -place[k]):
        e, n = edits[k], place[k]
        if not 0 <= n < len(units):
            fate[k] = "p_out_of_range"
        elif not e.current or e.current not in accepted_text(units[n]):
            fate[k] = "text_not_found"
        elif not e.comment_only and e.suggested != e.current and track(units[n], e.current, e.suggested, ids, author, date):
            fate[k] = "tracked"
        else:
            number += 1
            comment(units[n], number)
            notes.append((number, "\n".join(x for x in (f"{e.current} → {e.suggested}" if e.suggested and e.suggested != e.current else e.current, e.note) if x)))
            fate[k] = "commented"
    for i, text in notes:
        c = ElementTree.SubElement(old, W + "comment", {W + "id": str(i), W + "author": author, W + "date": date})
        for line in text.split("\n"):
            t = ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(c, W + "p"), W + "r"), W + "t")
            t.text = line
    parts["word/document.xml"] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    if notes:
        _attach_comments(parts, old)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body_ in parts.items():
            archive.writestr(name, body_)
    return out.getvalue(), fate


def _attach_comments(parts: dict[str, bytes], comments: ElementTree.Element) -> None:
    parts["word/comments.xml"] = ElementTree.tostring(comments, encoding="utf-8", xml_declaration=True)
    path = "word/_rels/document.xml.rels"
    ElementTree.register_namespace("", RELS[1:-1])
    rels = ElementTree.fromstring(parts[path]) if path in parts else ElementTree.Element(RELS + "Relationships")
    if not any(r.get("Type") == COMMENTS for r in rels):
        taken = [int(m[1]) for r in rels if (m := re.fullmatch(r"rId(\d+)", r.get("Id", "")))]
        ElementTree.SubElement(rels, RELS + "Relationship", {"Id": f"rId{max(taken, default=0) + 1}", "Type": COMMENTS, "Target": "comments.xml"})
    parts[path] = ElementTree.tostring(rels, encoding="utf-8", xml_declaration=True)
    types = "{http://schemas.openxmlformats.org/package/2006/content-types}"
    ElementTree.register_namespace("", types[1:-1])
    listing = ElementTree.fromstring(parts.get("[Content_Types].xml", f'<Types xmlns="{types[1:-1]}"/>'.encode()))
    if not any(x.get("PartName") == "/word/comments.xml" for x in listing):
        ElementTree.SubElement(listing, types + "Override", {"PartName": "/word/comments.xml", "ContentType": "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"})
    parts["[Content_Types].xml"] = ElementTree.tostring(listing, encoding="utf-8", xml_declaration=True)


def rejected_text(p: ElementTree.Element) -> str:
    """The paragraph's text with all changes undone."""
    gone = {id(t) for x in p.iter(W + "ins") for t in x.iter(W + "t")}
    return "".join(x.text or "" for x in p.iter() if x.tag in (W + "t", W + "delText") and id(x) not in gone)


def audit(data: bytes) -> list[str]:
    """Faults of a written document: broken archive or XML, relations to nowhere, comments without anchor or text."""
    faults = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        if (bad := archive.testzip()) is not None:
            faults.append(f"corrupt: {bad}")
    except zipfile.BadZipFile:
        return ["no archive"]
    names = set(archive.namelist())
    trees = {}
    for n in names:
        if n.endswith((".xml", ".rels")):
            try:
                trees[n] = ElementTree.fromstring(archive.read(n))
            except ElementTree.ParseError:
                faults.append(f"unreadable: {n}")
    for r in trees.get("word/_rels/document.xml.rels", ()):
        if r.get("TargetMode") != "External" and f"word/{r.get('Target', '')}" not in names and r.get("Target", "").lstrip("/") not in names:
            faults.append(f"dangling: {r.get('Id')}")
    doc = trees.get("word/document.xml")
    if doc is None:
        return [*faults, "no document"]
    ids = lambda tag: sorted(x.get(W + "id") for x in doc.iter(W + tag))
    known = sorted(c.get(W + "id") for c in trees.get("word/comments.xml", ()))
    if not ids("commentRangeStart") == ids("commentRangeEnd") == ids("commentReference") == known:
        faults.append("comments unpaired")
    return faults


def write(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """``path, content, fates``: documents (path, content) with their edits (path, location, current, suggested, note, comment_only).

    A document's edits are gathered, which are as many as reviewers wrote on one document.
    """
    fields = ("location", "current", "suggested", "note", "comment_only")
    g = edits.groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("edits"))

    def run(batches):
        for batch in batches:
            for path, content, listed in zip(*(c.to_pylist() for c in batch.columns)):
                made = [Edit(e["location"] or "", e["current"] or "", e["suggested"] or "", e["note"] or "", bool(e["comment_only"])) for e in listed or ()]
                out, fates = apply(content, made)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out], pa.binary()), pa.array([fates], pa.list_(pa.string()))], ["path", "content", "fates"])

    return documents.select("path", "content").join(g, "path", "left").mapInArrow(run, "path string, content binary, fates array<string>")
