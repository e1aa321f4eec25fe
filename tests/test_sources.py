import io
import json
import zipfile

from pyspark.sql import functions as F

from quire.operators import writeback
from quire.plans import checkpoint
from quire.sources import docx, files, html, layout
from quire.streaming import intake

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def document(body, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def p(*runs, style=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}{''.join(f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}</w:p>"


def test_docx_units():
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="x"><w:name w:val="Own"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
    body = p("第一章", style="1") + p(" ") + p("甲", "乙") + f"<w:tbl><w:tr><w:tc>{p('格')}</w:tc></w:tr></w:tbl>" + f'<w:p><w:del w:id="1"><w:r><w:delText>删</w:delText><w:t>删</w:t></w:r></w:del><w:ins w:id="2"><w:r><w:t>增</w:t></w:r></w:ins></w:p>' + p("末", style="x")
    got = docx.units(document(body, {"word/styles.xml": styles}))
    assert [(u[0], u[1], u[2], u[4]) for u in got] == [("P0", "paragraph", "第一章", 2), ("P1", "paragraph", "甲乙", None), ("P2", "table_cell", "格", None), ("P3", "paragraph", "增", None), ("P4", "paragraph", "末", 1)]
    assert docx.to_markdown(got).split("\n")[0] == "## 第一章"


def test_embedded_chunks():
    mail = "MIME-Version: 1.0\nContent-Type: text/html; charset=gb2312\nContent-Transfer-Encoding: 8bit\n\n".encode() + "<html><h1>题 目</h1><p>甲&amp;乙</p><script>x</script><p> </p></html>".encode("gb2312")
    rels = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x" Target="a.mht"/></Relationships>'
    got = docx.units(document('<w:altChunk r:id="r1"/>', {"word/_rels/document.xml.rels": rels, "word/a.mht": mail}))
    assert [(u[2], u[4]) for u in got] == [("题 目", 1), ("甲&乙", None)]
    assert html.paragraphs("") == [] and html.paragraphs("甲<br>乙") == [("甲", 0), ("乙", 0)]


def test_docx_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document(p("甲")))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = docx.read(spark, str(tmp_path)).collect()
    assert sorted((r["kind"], r["pos"]) for r in got) == [("error", 0), ("paragraph", 0)]
    assert files.manifest(spark, str(tmp_path)).count() == 2


def test_writeback_accepts_and_rejects():
    data = document(p("他说", "此处有错字了。") + p("两处两处"))
    edits = [writeback.Edit("P0", "有错字", "有个别字", "注"), writeback.Edit("P1", "两处", "一处"), writeback.Edit("P9", "x", "y"), writeback.Edit("P0", "无", "有")]
    out, fates = writeback.apply(data, edits)
    assert fates == ["tracked", "commented", "p_out_of_range", "text_not_found"] and writeback.audit(out) == []
    body = docx.ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml")).find(docx.W + "body")
    first = next(iter(body))
    assert docx.accepted_text(first) == "他说此处有个别字了。" and writeback.rejected_text(first) == "他说此处有错字了。"
    assert writeback.anchor("甲乙甲乙丙", 2, 2) == "甲乙甲乙丙" and writeback.anchor("aa", 0, 1) == "aa"
    assert writeback.audit(b"x") == ["no archive"]


def test_writeback_frame(spark):
    docs = spark.createDataFrame([("a", document(p("甲乙"))), ("b", document(p("丙")))], "path string, content binary")
    edits = spark.createDataFrame([("a", "P0", "甲", "子", None, False)], "path string, location string, current string, suggested string, note string, comment_only boolean")
    assert {r["path"]: r["fates"] for r in writeback.write(docs, edits).collect()} == {"a": ["tracked"], "b": []}


def test_findings_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"1_llm": [{"original_sentence": "甲", "corrected_sentence": "乙"}], "meta": {"n": 1}}))
    (tmp_path / "b.json").write_text(json.dumps([{"phase": "x", "char": "丙", "location": "P3", "fix_class": "polish"}, {"phase": "y"}]))
    got = files.findings(spark, str(tmp_path))
    assert {(r["phase"], r["original"], r["suggested"]) for r in got.collect()} == {("1_llm", "甲", "乙"), ("x", "丙", None)}
    good, bad = files.validated(got)
    assert good.count() == 1 and bad.first()["rule"] == "location_missing"
    (tmp_path / "l1").write_text('{"a": "1", "b": "2"}')
    (tmp_path / "l2").write_text('{"a": "3"}')
    assert {(r[0], r[1]) for r in files.lexicon(spark, str(tmp_path / "l1"), str(tmp_path / "l2")).collect()} == {("a", "3"), ("b", "2")}


def test_layout(spark, tmp_path):
    span = lambda c, **k: {"type": "text", "content": c, **k}
    pages = [{"page_idx": 0, "page_size": [500.0, 1000.0], "para_blocks": [{"type": "title", "level": 2, "bbox": [50, 100, 250, 200], "lines": [{"spans": [span("题")]}]}, {"type": "text", "bbox": [0, 0, 1, 1], "lines": [{"spans": [span("a hyphen-")]}, {"spans": [span("ated word")]}, {"spans": [span("next")]}]}], "discarded_blocks": [{"type": "discarded", "bbox": [0, 0, 1, 1], "lines": [{"spans": [span("①注一", original_label="footnote")]}, {"spans": [span("续")]}]}]}]
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1, "pages": pages}))
    blocks = layout.read(spark, str(tmp_path))
    assert layout.markdown(blocks).first()["text"] == "## 题\n\na hyphenated word next"
    assert layout.footnotes(blocks).first()["text"] == "①注一 续"
    assert layout.content_list(blocks).where("type = 'title'").first()["bbox"] == [100, 100, 500, 200]
    pages_ = spark.createDataFrame([(1, 0, "甲乙丙丁", "甲"), (1, 1, "甲", "甲")], "doc_id long, page int, raw string, markdown string")
    assert [r["text"] for r in layout.best_text(pages_).orderBy("page").collect()] == ["甲乙丙丁", "甲"]


def test_review_resumes(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"h{k}", t) for k, t in enumerate(["甲", "乙", "坏", ""])], "chunk_id long, chunk_sha256 string, target string")

    def fails(text):
        raise TimeoutError("slow")

    def answers(text):
        if text == "坏":
            raise ValueError("no")
        return '{"findings": []}'

    path, calm = str(tmp_path / "t"), lambda s: None
    first = checkpoint.run_until_done(chunks, path, "run", [("down", fails), ("up", answers)], rounds=2, sleep=calm, concurrent=2, rpm=1e9, attempts=2)
    assert {r["chunk_id"]: r["status"] for r in first.collect()} == {0: "complete", 1: "complete", 2: "failed", 3: "complete"}
    assert first.where("chunk_id = 0").first()["attempts"] == 3
    rows = spark.read.parquet(path).count()
    checkpoint.run_until_done(chunks.where("chunk_id <> 2"), path, "run", [("up", fails)], sleep=calm, rpm=1e9)
    assert spark.read.parquet(path).count() == rows
    slept = []
    now = iter([0.0, 1.0, 5.0, 20.0])
    limiter = checkpoint.Limiter(15, clock=lambda: next(now), sleep=slept.append)
    for _ in range(4):
        limiter.wait()
    assert slept == [3.0, 3.0]


def test_intake(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    batch = lambda ids: spark.createDataFrame([(i, f"文{i % 3}", "2024-01-01 00:00:00") for i in ids], "doc_id long, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("loaded_at"))
    batch(range(4)).write.mode("append").parquet(land)
    check = lambda s: s.select("doc_id", F.length("text").alias("n"))
    for _ in range(2):
        intake.run(intake.landing(spark, land, "doc_id long, text string, loaded_at timestamp"), out, state, check)
        assert spark.read.parquet(out).count() == 3
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert intake.sessions(events, "30 minutes").count() == 2
