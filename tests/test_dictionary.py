import zlib

from quire.sources import dictionary as D


def test_dictionary(spark):
    pack = lambda x: zlib.compress(x.encode())
    rows = [("a", "图书", pack("<b>tú</b>shū <i>义</i>")), ("b", "图书", pack("书")), ("a", "x1", pack("y")), ("a", "坏", b"no")]
    d = spark.createDataFrame(rows, "dict string, entry string, paraphrase binary")
    terms = spark.createDataFrame([("图书",), ("无",), ("坏",)], "term string")
    assert {(r["term"], r["dict"], r["text"]) for r in D.look_up(terms, d).collect()} == {("图书", "a", "túshū 义"), ("图书", "b", "书"), ("坏", "a", None)}
    assert [(r["headword"], r["dictionaries"]) for r in D.headwords(d).collect()] == [("图书", 2)]
    assert D.known(spark.createDataFrame([("图书",), ("无",)], "word string"), d).count() == 1
    rules = spark.createDataFrame([("a", "pinyin", r"<b>([^<]+)</b>"), ("a", "sense", r"<i>([^<]+)</i>")], "dict string, kind string, pattern string")
    assert {(r["kind"], r["value"]) for r in D.extracted(d, rules).collect()} == {("pinyin", "tú"), ("sense", "义")}
    assert D.entries(d, 1).count() == 1 and {r["dict"]: r["entries"] for r in D.info(d).collect()} == {"a": 3, "b": 1}


def test_lists(spark, tmp_path):
    (tmp_path / "v.txt").write_text("按语（案语、*暗语）①\n百废俱兴—百废具兴\n辈分［辈份］\n不成行\n①见注\n", encoding="utf-8")
    got = {(r["standard"], r["variant"], r["note"]) for r in D.variant_list(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {("按语", "案语", "见注"), ("按语", "暗语", "见注"), ("百废俱兴", "百废具兴", None), ("辈分", "辈份", None)}
    (tmp_path / "r.csv").write_text("甲,,1900\n,x,1\n乙,号\n丙,号,1901\n", encoding="utf-8")
    assert {r["head"] for r in D.records(spark, str(tmp_path / "r.csv")).collect()} == {"甲", "丙"}
    (tmp_path / "b.tsv").write_text("D年\t5\n的人\t7\n", encoding="utf-8")
    assert D.bigrams(spark, str(tmp_path / "b.tsv")).where("frequency = 5").first()["pattern"] == "[0-9]年"
