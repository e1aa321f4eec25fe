from pyspark.sql import functions as F

from quire.operators import pages, report, segment, structure, tidy


def test_pages(spark):
    chars = [(1, p, s, ch, p * 10 + s // 4, float(s), 0.0, float(s + 1), 1.0) for p, text in enumerate(["甲乙 丙丁", "戊己甲乙"]) for s, ch in enumerate(text)]
    idx = pages.index(spark.createDataFrame(chars, "doc_id int, page int, seq int, ch string, line_id int, x0 double, y0 double, x1 double, y1 double"))
    texts = pages.streams(idx)
    assert texts.first()["text"] == "甲乙丙丁戊己甲乙"
    needles = spark.createDataFrame([(1, 1, "乙 丙"), (2, 1, "丁戊"), (3, 1, "甲乙"), (4, 1, "无")], "needle_id int, doc_id int, needle string")
    found = pages.occurrences(texts, needles)
    got = {r["needle_id"]: (r["status"], r["start_pos"]) for r in pages.located(found, idx).collect()}
    assert got == {1: ("exact", 1), 2: ("crosspage", 3), 3: ("ambiguous", 0)}
    hint = spark.createDataFrame([(3, 1)], "needle_id int, page_hint int")
    assert pages.located(found, idx, hint).where("needle_id = 3").first()["start_pos"] == 6
    q = pages.quads(pages.located(found, idx).where("needle_id = 2"), idx).orderBy("page").collect()
    assert [(r["page"], r["x0"], r["x1"]) for r in q] == [(0, 4.0, 5.0), (1, 0.0, 1.0)]
    assert spark.range(1).select(pages.fragments(F.lit("甲乙，丙丁戊己庚辛12天地玄黄宇宙洪荒"))).first()[0] == ["天地玄黄宇宙洪荒", "丙丁戊己庚辛"]


def test_tidy(spark):
    assert tidy.join_lines("甲" * 30 + "\n乙" + "\n丙") == "甲" * 30 + "乙\n丙" and tidy.join_lines("") == ""
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tidy.mark_styles(F.lit("[甲]{.s1}[乙]{.s2}"), {"s1": "**$1**"})) == "**甲**乙"
    docs = spark.createDataFrame([(1, "1. 甲\n\n2. 乙\n文\n1. 丙")], "doc_id int, text string")
    assert [r["line"] for r in tidy.footnote_lists(segment.to_lines(docs)).orderBy("line_no").collect()] == ["[^a]: 甲", "", "[^b]: 乙", "文", "[^a]: 丙"]
    toc = spark.createDataFrame([(1, "引 言", 2), (1, "无", 1)], "doc_id int, name string, level int")
    marked, missing = tidy.mark_titles(segment.to_lines(spark.createDataFrame([(1, "引言\n文")], "doc_id int, text string")), toc)
    assert [r["line"] for r in marked.orderBy("line_no").collect()] == ["## 引言", "文"] and [r["name"] for r in missing.collect()] == ["无"]


def test_report(spark):
    a = spark.createDataFrame([(0, "match", "甲", "甲", 1.0), (1, "delete", "Ab", None, 0.0), (7, "insert", None, "<b>", 0.0)], "seq int, type string, a string, b string, similarity double")
    assert [r["seq"] for r in report.select(a, text="ab").collect()] == [1]
    assert [r["seq"] for r in report.select(a, indices="0, 5-").orderBy("seq").collect()] == [0, 7]
    assert report.select(a, types=["match"], low=0.5).count() == 1
    assert "&lt;b&gt;" in report.alignment_html(a.collect(), "x")
    nodes = structure.tree(spark.createDataFrame([(1, "# 第一章 甲\n## 第一节 乙\n# 第二章 丙")], "doc_id int, text string")).collect()
    tree = report.tree_json(nodes)
    assert [n["raw_text"] for n in tree] == ["第一章", "第二章"] and tree[0]["children"][0]["raw_text"] == "第一节"
    f = spark.createDataFrame([(1, "error", "一", 5), (1, "info", None, None), (1, "warn", "零", 1)], "doc_id int, severity string, chapter string, position int")
    assert [r["chapter"] for r in report.by_chapter(f).collect()] == ["零", "一", "结构诊断"] and report.cards(f).first()["total"] == 3


def test_cascade(spark):
    pages_ = ["盐船逆水而上码头夜里点灯渡口无人", "书稿送到灯塔值更的人已经睡了", "盐船逆水而上码头夜里点灯渡口无人看管又来一句收尾"]
    chars = [("d", p, p * 100, k, ch, 1.0 * k, 0.0, 1.0 * k + 1, 1.0) for p, t in enumerate(pages_, 1) for k, ch in enumerate(t)]
    idx = pages.index(spark.createDataFrame(chars, "doc_id string, page int, line_id int, seq int, ch string, x0 double, y0 double, x1 double, y1 double"))
    rows = [
        (1, "d", "书稿送到灯塔", None),  # exact
        (2, "d", "盐船逆水而上", None),  # on two pages
        (3, "d", "盐船逆水而上", 3),  # the hint decides
        (4, "d", "书稿送到灯塔值更的人，却无别话", None),  # a fragment
        (5, "d", "书稿送至灯塔值更的人已经睡了", 2),  # fuzzy by one letter, but a fragment comes first
        (6, "d", "书稿送到灯塔值更的入已经睡了啊", None),
        (7, "d", "无此", None),
        (8, "d", "短", None),
        (9, "d", None, None),
        (10, "d", "书搞送到灯踏值更的", None),  # no fragment has a place
    ]
    needles = spark.createDataFrame(rows, "needle_id int, doc_id string, needle string, page_hint int")
    got = {r["needle_id"]: (r["method"], r["status"]) for r in pages.cascade(needles, idx).collect()}
    assert len(got) == len(rows)
    assert got[1] == ("exact", "hit") and got[2] == ("exact", "ambiguous") and got[3] == ("exact", "hit")
    assert got[4] == ("fragment", "preview") and got[7] == got[8] == got[9] == ("none", "skip")
    assert got[5][0] == "fuzzy" and got[5][1] == "preview" and got[6][0] in ("fuzzy", "none")
    allowed = {r["needle_id"]: (r["method"], r["status"]) for r in pages.cascade(needles, idx, True, True).collect()}
    assert allowed[4] == ("fragment", "hit") and allowed[5] == ("fuzzy", "hit")
    assert pages.cascade(needles.limit(0), idx).count() == 0
    assert pages.similar_place("甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛壬子", "甲乙丙丁戊己庚辛壬丑", 0, 20) is not None
    assert pages.similar_place("甲乙丙", "甲乙丙丁", 0, 3) is None
