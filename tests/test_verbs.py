from quire.plans import verbs

from .test_sources import document, p


def test_verbs(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document(p("第一章 甲") + p("图书")))
    (tmp_path / "b.md").write_text("# 第一章 甲\n# 第三章 丙\n圖書圖書", encoding="utf-8")
    docs = verbs.documents(spark, str(tmp_path))
    assert {r["path"][-4:] for r in docs.collect()} == {"docx", "b.md"}
    forms = spark.createDataFrame([("圖", "traditional", "图")], "ch string, kind string, standard_ch string")
    standard = spark.createDataFrame([(c,) for c in "第一三章甲丙图书書"], "ch string")
    words = spark.createDataFrame([("圖書", "图书")], "word string, standard string")
    got = verbs.special(docs, forms, standard, words).groupBy("phase", "type").count().collect()
    assert {(r["phase"], r["type"], r["count"]) for r in got} == {("characters", "traditional", 2), ("words", "variant_word", 2), ("structure", "continuity_error", 1)}
    old = spark.createDataFrame([(1, "甲乙丙丁戊。己庚辛壬癸。")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "甲乙丙丁戊。子丑寅卯辰巳。")], "doc_id long, text string")
    assert sorted(r["type"] for r in verbs.diff(old, new).collect()) == ["delete", "insert", "match"]
    done = verbs.book(docs, str(tmp_path / "t"), [("p", lambda t: "[]")], sleep=lambda s: None, rpm=1e9)
    assert {r["status"] for r in done.collect()} == {"complete"}
