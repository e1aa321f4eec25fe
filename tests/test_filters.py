import random

from pyspark.sql import functions as F

from quire.operators import checker, filters, locate, report, segment, tidy
from quire.plans import checkpoint, verbs
from quire.sources import dictionary, docx, files

from .test_sources import document, p


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict()


def test_labels_and_numbers(spark):
    lit = F.lit
    got = one(
        spark,
        focus=filters.focus_pair(lit("甲" * 25), lit(None).cast("string")),
        pn=filters.paragraph_number(lit("见 P12 段")),
        no_pn=filters.paragraph_number(lit("第12段")),
        page=filters.page_hint(lit(" 7 "), lit(9))[0],
        beyond=filters.page_hint(lit("10"), lit(9))[1],
        unread=filters.page_hint(lit("x"), lit(9))[1],
        missing=filters.page_hint(lit(None).cast("string"), lit(9))[1],
        form=filters.note_of(lit("系(系、係分用)"))[0],
        note=filters.note_of(lit("系(系、係分用)"))[1],
        bare=filters.note_of(lit("系"))[0],
        star=filters.single_form_kind(lit("乙<sup>2*</sup>")),
        other=filters.single_form_kind(lit("⁑乙")),
        old=filters.single_form_kind(lit("乙<sup>2</sup>")),
        labels=filters.labels(lit("0_char"), lit("variant"), lit("error")),
        style=filters.style_class(lit(None).cast("string"), lit("0c_structure")),
    )
    assert got == {"focus": '"' + "甲" * 20 + '"→""', "pn": 12, "no_pn": None, "page": 7, "beyond": "out_of_range", "unread": "unreadable", "missing": "missing", "form": "系", "note": "系、係分用", "bare": "系", "star": "standard_variant", "other": "other_variant", "old": "traditional", "labels": "字形、必改", "style": "polish"}


def test_filters(spark):
    f = spark.createDataFrame([("図", 1), ("A", 2), ("。", 3), (None, 4), ("書", 5)], "ch string, n int")
    assert [r["n"] for r in filters.not_ignored(f).orderBy("n").collect()] == [1, 5]
    assert [r["n"] for r in filters.not_ignored(f, spark.createDataFrame([("図",)], "ch string")).collect()] == [5]
    rows = spark.createDataFrame([(k,) for k in range(1, 9)], "idx int")
    done = spark.createDataFrame([(3,), (3,)], "idx int")
    assert [r["idx"] for r in filters.selected(rows, done, 2, 5).orderBy("idx").collect()] == [2, 4, 5]
    assert [r["idx"] for r in filters.selected(rows, None, numbers=[8, 1]).orderBy("idx").collect()] == [1, 8]
    assert filters.selected(rows.limit(0), done).count() == 0
    single, longer = filters.by_key_length(spark.createDataFrame([("甲", 1), ("甲乙", 2), ("", 3)], "k string, v int"))
    assert [r["v"] for r in single.collect()] == [1] and [r["v"] for r in longer.collect()] == [2]


def test_edit_reasons(spark):
    cases = [("甲乙", "乙", "丙", 90.0), ("甲乙", "乙", "乙", 90.0), ("甲乙", "", "丙", 90.0), ("甲乙", "丁", "丙", None), (None, "乙", "丙", 90.0), ("甲乙", "乙", "丙", 59.9), ("甲乙", "乙", "丙", 60.0)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, o string, c string, r double")
    got = [r["why"] for r in df.select("k", filters.edit_reason(F.col("t"), F.col("o"), F.col("c"), F.col("r")).alias("why")).orderBy("k").collect()]
    assert got == [None, "no_op_change", "no_op_change", "match_no_location", "match_no_location", "match_below_threshold", None]


def test_check_and_correct(spark):
    docs = spark.createDataFrame([(1, "共12 公里，，较对与较对。"), (2, None), (3, ""), (4, "alpha beta alpha beta gamma beta")], "doc_id long, text string")
    words = spark.createDataFrame([("较对", "校对")], "word string, standard string")
    rare = checker.check_text(docs, words, below=0.3).where("kind = 'ngram_error' and doc_id = 4")
    assert {(r["start_pos"], r["original"]) for r in rare.collect()} == {(6, "beta alpha"), (17, "beta gamma"), (22, "gamma beta")}
    assert {(r["kind"], r["start_pos"], r["end_pos"]) for r in checker.check_text(docs, words).where("doc_id = 1").collect()} == {("number_unit", 1, 6), ("punctuation", 6, 8), ("word_error", 8, 10)}
    fixed = locate.apply_replacements(docs, checker.corrections(checker.check_text(docs, words)))
    assert {r["doc_id"]: r["text"] for r in fixed.collect()}[1] == "共12公里，校对与较对。"
    assert checker.check_text(docs.limit(0), words, below=0.5).count() == 0


def test_letter_notes():
    text = "渡船a停在b岸（bà）。\na　盐船：注。\nThe kiln c"
    assert tidy.letter_notes(text) == "渡船[^a]停在b岸（bà）。\n[^a]:　盐船：注。\nThe kiln c"
    assert tidy.letter_notes("") == ""


def test_reports(spark):
    df = spark.createDataFrame([("甲<乙", "甲丙", "warn", "t", "r" * 130, 75.0), (None, "x", None, None, None, None)], "original string, suggested string, severity string, type string, reason string, ratio double")
    got = [r["d"] for r in df.select(report.diff_html("original", "suggested").alias("d")).collect()]
    assert got == ["甲<del>&lt;乙</del><ins>丙</ins>", None]
    rows = [r["row"] for r in report.finding_rows(df).collect()]
    assert "甲&lt;乙" in rows[0] and "r" * 120 + "…" in rows[0] and rows[1].startswith('<tr class="info">')
    assert "匹配率 75.0" in report.issue_items(df).first()["item"]
    note = one(spark, n=report.annotation(F.lit("[改]"), F.lit("甲"), F.lit("乙"), F.lit(" "), F.array(F.lit("错字"), F.lit("错字"), F.lit("乙")), F.array(F.struct(F.lit("书").alias("title"), F.lit("http://x.y").alias("url"), F.lit("2020").alias("accessed_at")))))
    assert note["n"] == "[改] 甲\n→ 乙\n理由：错字\n依据：书（访问于 2020）\nhttp://x.y"


def test_paragraphs(spark):
    units = spark.createDataFrame([("d", "body", 0, "甲——乙"), ("d", "body", 1, " "), ("d", "body", 2, "丙“丁”"), ("d", "footer", 0, "页脚"), ("d", "header", 0, "页眉")], "path string, part string, pos int, text string")
    edits = spark.createDataFrame([("d", 0, "甲--乙"), ("d", 1, '丙"丁"'), ("d", 2, "页眉"), ("d", 3, "页脚"), ("d", 1, "甲"), ("d", 9, "x"), ("d", 0, "")], "path string, pn int, anchor string")
    assert {(r["pn"], r["anchor"]): r["found"] for r in locate.in_paragraph(edits, units).collect()} == {(0, "甲--乙"): True, (1, '丙"丁"'): True, (2, "页眉"): True, (3, "页脚"): True, (1, "甲"): False, (9, "x"): False, (0, ""): False}


def test_merged_cuts(spark):
    rng = random.Random(9)
    texts = ["\n\n".join("甲" * rng.randint(1, 400) + "。" for _ in range(rng.randint(1, 30))) for _ in range(20)]
    got = {}
    for r in segment.merged_cuts(spark.createDataFrame([*enumerate(texts), (99, None), (98, " \n ")], "doc_id long, text string")).orderBy("doc_id", "piece_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["target"])
    assert set(got) == set(range(20))
    for k, t in enumerate(texts):
        assert "".join("".join(got[k]).split()) == "".join(t.split())
        assert all(len(x) >= 120 for x in got[k][:-1])


def test_hard_split_tries_half_the_size():
    assert segment.hard_split("甲" * 24 + "。" + "乙" * 80, 50) == ("甲" * 24 + "。", "乙" * 80)
    assert segment.hard_split("甲" * 23 + "。" + "乙" * 80, 50)[0] == "甲" * 23 + "。" + "乙" * 26
    assert segment.cut("甲" * 60 + "\n\n" + "乙", 50) == ["甲" * 60 + "\n", "乙"]


def test_dictionaries(spark):
    d = spark.createDataFrame([("x", "甲", b"2", 2), ("x", "甲", b"1", 1), ("y", "甲", b"0", 3), ("x", "乙", b"3", 4)], "dict string, entry string, paraphrase binary, row_id int")
    assert {r["dict"]: (r["entries"], r["headwords"]) for r in dictionary.info(d).collect()} == {"x": (3, 2), "y": (1, 1)}
    terms = spark.createDataFrame([("甲",), ("无",)], "term string")
    import zlib

    z = spark.createDataFrame([("x", "甲", zlib.compress("后".encode()), 1), ("x", "甲", zlib.compress("先".encode()), 0)], "dict string, entry string, paraphrase binary, row_id int")
    assert [r["text"] for r in dictionary.look_up(terms, z).collect()] == ["先"]


def test_runs_are_kept_apart(spark):
    chunks = spark.createDataFrame([("r1", 1, "h"), ("r2", 1, "h")], "run_key string, chunk_id long, chunk_sha256 string")
    have = spark.createDataFrame([("r1", 1, "h", "complete", "[]")], "run_key string, chunk_id long, chunk_sha256 string, status string, findings_json string")
    assert [r["run_key"] for r in checkpoint.pending(chunks, have).collect()] == ["r2"]
    assert checkpoint.pending(chunks.drop("run_key"), have).count() == 0
    assert checkpoint.provider_for("m", {"a": {"models": ["m"], "url": "u"}}) == ("a", {"url": "u"})


def answer(text):
    return "[]"


def test_files_and_verbs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(document(p("第一章 甲") + p("图书")))
    (folder / "b.md").write_text("# 第一章 甲\n# 第三章 丙", encoding="utf-8")
    (folder / "c.md").write_text(" \n", encoding="utf-8")
    (folder / "d.txt").write_text("x", encoding="utf-8")
    got = {r["path"][-5:]: r["errors"] for r in files.review_source(spark, str(folder)).groupBy("path").agg(F.collect_set("error").alias("errors")).collect()}
    assert got == {".docx": [], "/b.md": [], "/c.md": ["no_text"], "d.txt": ["unsupported"]}
    assert files.source_of("/x/a_findings.json", ["/x/a.docx", "/x/ab.docx", "/y/a.docx"]) == "/x/a.docx" and files.source_of("/x/q.json", []) is None
    assert not docx.uses_embedded_body((folder / "a.docx").read_bytes())
    skipped = spark.createDataFrame([("no_op_change", 1), ("no_op_change", 2), ("fuzzy_tie", 3)], "reason string, finding_id int")
    files.write_skipped(skipped, str(tmp_path / "skipped"))
    assert {r["reason"]: r["skipped"] for r in spark.read.json(str(tmp_path / "skipped/counts")).collect()} == {"no_op_change": 2, "fuzzy_tie": 1}
    verbs.main(["special", str(folder), "--out", str(tmp_path / "special")])
    lines = [x for f in sorted((tmp_path / "special/csv").glob("part-*")) for x in f.read_text("utf-8").splitlines()]
    assert lines[0] == "\ufefftype,original,suggestion,start_pos,severity" and any(x.startswith("continuity_error") for x in lines)
    verbs.main(["b", str(folder), "--out", str(tmp_path / "book"), "--provider", f"{__name__}:answer"])
    assert spark.read.json(str(tmp_path / "book/rows")).count() > 0
    (tmp_path / "edits.json").write_text('{"path": "a", "location": "P1", "current": "图书", "suggested": "图画", "note": "", "comment_only": false}\n', encoding="utf-8")
    verbs.main(["writeback", str(folder), str(tmp_path / "edits.json"), "--out", str(tmp_path / "back")])
    assert spark.read.parquet(str(tmp_path / "back")).first()["fates"] is not None
