"""Word documents: their paragraphs in order, in the view with all changes accepted."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import html

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"

UNITS = "path string, sha256 string, pos int, location string, kind string, text string, style string, heading_level int"


def accepted_text(paragraph: ElementTree.Element) -> str:
    """Text of the runs that are not deleted; tabs and breaks are kept as characters."""
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == W + "del":
                continue
            if child.tag == W + "t":
                out.append(child.text or "")
            elif child.tag == W + "tab":
                out.append("\t")
            elif child.tag in (W + "br", W + "cr"):
                out.append("\n")
            walk(child)

    walk(paragraph)
    return "".join(out)


def styles(archive: zipfile.ZipFile) -> dict[str, tuple[str, int | None]]:
    """Style id to its name and outline level."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    out = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(W + "style"):
        name, outline = style.find(W + "name"), style.find(f"{W}pPr/{W}outlineLvl")
        out[style.get(W + "styleId", "")] = (name.get(W + "val", "") if name is not None else "", int(outline.get(W + "val")) if outline is not None else None)
    return out


def heading_level(name: str, outline: int | None) -> int | None:
    """From a style's name, else from its outline level, which counts from zero."""
    if m := re.search(r"(?:heading|标题)\s*(\d)", name, re.I):
        return int(m[1])
    return outline + 1 if outline is not None and outline < 9 else None


def body_paragraphs(body: ElementTree.Element) -> Iterator[tuple[ElementTree.Element, str]]:
    """Paragraphs and those of table cells, in order."""
    for child in body:
        if child.tag == W + "p":
            yield child, "paragraph"
        elif child.tag == W + "tbl":
            for p in child.iter(W + "p"):
                yield p, "table_cell"
        elif child.tag == W + "sdt":
            for content in child.iter(W + "sdtContent"):
                yield from body_paragraphs(content)


def embedded(archive: zipfile.ZipFile, body: ElementTree.Element) -> list[bytes]:
    """The chunks that the body takes in from other parts, in the order of the body."""
    path = "word/_rels/document.xml.rels"
    chunks = [x.get(R + "id") for x in body.iter(W + "altChunk")]
    if not chunks or path not in archive.namelist():
        return []
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read(path)).iter(RELS + "Relationship")}
    names = [posixpath.normpath(posixpath.join("word", targets[c])) if not targets[c].startswith("/") else targets[c][1:] for c in chunks if c in targets]
    return [archive.read(n) for n in names if n in archive.namelist()]


def units(data: bytes) -> list[tuple[str, str, str, str | None, int | None]]:
    """``(location, kind, text, style, heading level)``; ``P<n>`` counts the paragraphs that are not blank, from 0.

    A body without text of its own that takes in chunks has the paragraphs of those.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
        known = styles(archive)
        out = []
        for p, kind in body_paragraphs(body):
            text = accepted_text(p)
            if not text.strip():
                continue
            ref = p.find(f"{W}pPr/{W}pStyle")
            name, outline = known.get(ref.get(W + "val", ""), (ref.get(W + "val", ""), None)) if ref is not None else (None, None)
            own = p.find(f"{W}pPr/{W}outlineLvl")
            level = heading_level(name or "", int(own.get(W + "val")) if own is not None else outline)
            out.append((f"P{len(out)}", kind, text, name, level))
        if not out:
            for part in embedded(archive, body):
                for text, level in html.paragraphs(html.mail_html(part)):
                    out.append((f"P{len(out)}", "paragraph", text, None, level or None))
        return out


def to_markdown(rows: list[tuple[str, str, str, str | None, int | None]]) -> str:
    return "\n".join(("#" * level + " " if level else "") + text for _, _, text, _, level in rows)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256, pos, location, kind, text, style, heading_level`` of all documents under a folder.

    A file that is no Word document gives one row of kind ``error`` with the reason as its text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder).select("path", F.sha2("content", 256).alias("sha256"), "content")

    def run(batches):
        for batch in batches:
            for path, sha, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows = units(data)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows = [("", "error", f"{type(e).__name__}: {e}", None, None)]
                cols = list(zip(*rows)) or [()] * 5
                arrays = [pa.array([path] * len(rows)), pa.array([sha] * len(rows)), pa.array(range(len(rows)), pa.int32())]
                arrays += [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in UNITS.split(", ")])

    return files.mapInArrow(run, UNITS)


def uses_embedded_body(data: bytes) -> bool:
    """Whether a document takes its body from other parts: at least one chunk, and no paragraph or table of its own with text."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
        return body is not None and next(body.iter(W + "altChunk"), None) is not None and not any(accepted_text(p).strip() for p, _ in body_paragraphs(body))


class DocxSource(DataSource):
    """``spark.read.format("docx_units").load(path)``: the units of one Word document or of all in a folder, each file read by its own task."""

    @classmethod
    def name(cls) -> str:
        return "docx_units"

    def schema(self) -> str:
        return UNITS

    def reader(self, schema) -> DataSourceReader:
        return _DocxReader(self.options["path"])


class _DocxReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path.removeprefix("file:"))
        return [InputPartition(str(f)) for f in ([root] if root.is_file() else sorted(root.rglob("*.docx")))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        data = Path(partition.value).read_bytes()
        sha = hashlib.sha256(data).hexdigest()
        try:
            rows = units(data)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
            rows = [("", "error", f"{type(e).__name__}: {e}", None, None)]
        for pos, row in enumerate(rows):
            yield (partition.value, sha, pos, *row)
