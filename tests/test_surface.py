import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.functions import register
from quire.operators import dictionary, ordered, report, structure
from quire.sources import docx, html
from quire.streaming import pace

from .test_sources import document, p


def test_functions_in_sql(spark):
    names = register.register(spark)
    assert {"lcs_ratio", "squeeze"} <= set(names)
    got = spark.sql("SELECT squeeze(' 甲　乙\\t') AS a, half_width('ＡＢ１') AS b, fold_quotes('“甲”‘乙’') AS c, round(lcs_ratio('甲乙丙', '甲丙'), 1) AS d, strip_tags('<b>甲</b>') AS e, squeeze(NULL) AS f").first()
    assert tuple(got) == ("甲乙", "AB1", "\"甲\"'乙'", 80.0, "甲", None)


def test_word_documents_are_a_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document(p("第一章 甲") + p("图书")))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    spark.dataSource.register(docx.DocxSource)
    rows = spark.read.format("docx_units").load(str(tmp_path)).collect()
    same = docx.read(spark, str(tmp_path)).collect()
    plain = lambda rs: sorted((r["path"][-6:], r["pos"], r["kind"], r["text"] if r["kind"] != "error" else "", r["sha256"]) for r in rs)
    assert plain(rows) == plain(same) and len(rows) == 3
    (tmp_path / "empty").mkdir()
    assert spark.read.format("docx_units").load(str(tmp_path / "empty")).count() == 0


def brute_pace(times, gap):
    free, out = None, []
    for t in times:
        at = t if free is None else max(t, free)
        out.append(at)
        free = at + gap
    return out


def test_paced_calls(spark):
    rng = random.Random(1)
    start = datetime(2020, 1, 1)
    rows = [(n, rng.choice([1, 1, 1, 2, None]), start + timedelta(seconds=rng.randint(0, 3 * 86400))) for n in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {}
    for r in ordered.paced(df, "user_id", 900_000_000, "event_id").orderBy("ts", "event_id").collect():
        got.setdefault(r["user_id"], []).append((r["ts"], r["at_us"]))
    micros = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert set(got) == {1, 2, None}
    for seen in got.values():
        assert [a for _, a in seen] == brute_pace([micros(t) for t, _ in seen], 900_000_000)


def test_paced_stream(spark, tmp_path):
    start = datetime(2020, 1, 1)
    for k in range(2):
        spark.createDataFrame([(10 * k + n, 7, start + timedelta(seconds=10 * k + n)) for n in range(3)], "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pace.paced(stream, "user_id", 5_000_000).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    at = sorted(r["at_us"] for r in spark.table("paced").collect())
    assert len(at) == 6 and all(b - a >= 5_000_000 for a, b in zip(at, at[1:]))


def test_pages_of_html(spark):
    a = spark.createDataFrame([(1, 1, "insert", None, "<b>", 0.0), (1, 0, "match", "甲", "甲", 1.0), (2, 0, "delete", "乙", None, 0.0)], "pair_id long, seq int, type string, a string, b string, similarity double")
    page = {r["pair_id"]: r["page"] for r in report.alignment_pages(a).collect()}
    assert page[1].index("甲") < page[1].index("&lt;b&gt;") and 'value="insert"' in page[1] and 'value="delete"' not in page[1]
    f = spark.createDataFrame([(1, "二", 9, "甲", "乙", "r", 100.0, "error"), (1, None, None, "丙", "丁", None, None, "warn"), (1, "一", 3, "戊", "己", "r", 70.0, "info")], "doc_id long, chapter string, position int, original string, suggested string, reason string, ratio double, severity string")
    body = report.finding_pages(f).first()["page"]
    assert body.index("一") < body.index("二") < body.index("结构诊断") and "total 3" in body
    pages = spark.createDataFrame([(1, "<h2>题</h2><p>甲</p>乙"), (2, ""), (3, None)], "k long, m string")
    assert [(r["k"], r["text"]) for r in html.to_markdown(pages, "k", "m").collect()] == [(1, "## 题\n\n甲\n\n乙")]


def test_rendered_trees(spark):
    df = spark.createDataFrame([(1, "# 第一章 盐\n## 第一节 茶\n# 第二章 <米>"), (2, "平文"), (3, None)], "doc_id long, text string")
    r = structure.rendered(df).collect()
    assert len(r) == 1
    tree = json.loads(r[0]["json"])
    assert [x["raw"] for x in tree] == ["第一章", "第二章"] and tree[0]["children"][0]["number"] == 1
    assert r[0]["html"].count("<li") == 3 and 'id="h2-section"' in r[0]["html"]


def test_distribution(spark):
    s = spark.createDataFrame([("x", "甲", None, "1"), ("y", "乙", "号", "2"), ("z", "丙", None, "3"), ("x", "甲", None, "1")], "bucket string, head string, label string, raw string")
    extra = spark.createDataFrame([("甲", None, "9"), ("丁", None, "4")], "head string, label string, raw string")
    packed, wrong = dictionary.distribution(s, ["x", "y"], extra)
    assert {r["head"] for r in packed.collect()} == {"甲", "乙", "丁"} and wrong.count() == 0
    t = dictionary.tables_of(spark.createDataFrame([({"a": "1"}, 5)], "p map<string,string>, q int"), ["p", "r"]).first()
    assert t["p"] == {"a": "1"} and t["r"] == {}
    assert spark.range(1).select(F.lit(1)).count() == 1
