import random

from pyspark.sql import functions as F

from quire.functions import similarity as S
from quire.functions import text as T
from quire.operators import dictionary, lexicon, locate, ordered, segment


def brute_window(text, fragment, slack=3):
    n, best = len(fragment), None
    if n >= 2 and (at := text.find(fragment)) >= 0:
        return fragment, at, 100.0
    for size in range(max(2, n - slack), n + slack):
        for at in range(len(text) - size + 1):
            w = text[at : at + size]
            r = S.ratio(fragment, w)
            if best is None or r > best[2] or r == best[2] and w[0] == fragment[0] and best[0][0] != fragment[0]:
                best = (w, at, r)
    return best


def test_best_match_is_the_first_best_window():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 25)))
        fragment = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
        assert S.best_match(text, fragment) == brute_window(text, fragment)
    assert S.best_match("", "甲") is None and S.best_match("甲", "") is None


def test_similarity(spark):
    assert S.ratio("", "") == 100.0 and S.ratio("abcd", "abd") == 200 * 3 / 7
    assert S.common_substring("甲乙丙丁", "丙丁甲乙") == "甲乙"
    assert S.partial_ratio("乙丙", "甲乙丙丁")[0] == 100.0
    assert S.coverage("", "x") == 1.0 and S.coverage("甲 乙", "甲乙丙") == 1.0
    df = spark.createDataFrame([("甲乙丙", "甲乙丁"), (None, "甲"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.lcs_ratio("a", "b")).collect()] == [200 * 2 / 6, None, 100.0]
    assert df.select(S.edit_spans("a", "b").alias("s")).first()["s"][1]["tag"] == "replace"
    r = df.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert r[0]["j"] == 1 / 3 and r[2]["j"] == 0.0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.squeeze(F.lit(" 甲　乙 \n"))) == "甲乙"
    assert one(T.half_width(F.lit("Ａ１z"))) == "A1z"
    assert one(T.clean_title(F.lit("第1章 引言……12"))) == "第章引言"
    assert one(T.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(F.size(T.json_findings(F.lit('```json\n{"findings": [{"a": "1"}]}\n```')))) == 1
    assert one(F.size(T.json_findings(F.lit('{"findings": []}')))) == 0
    assert one(T.json_findings(F.lit('{"issues": []}'))) is None
    assert one(T.json_findings(F.lit("[{"))) is None
    assert one(T.lines(F.lit("a\r\nb c\n"))) == ["a", "b", "c"]


def test_sentences_join_to_the_text():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("甲乙。！.3…”\n #-") for _ in range(rng.randint(0, 60)))
        assert "".join(segment.split_simple(text)) == text
        assert "".join(segment.split_markdown(text)) in (text, "")
    assert segment.split_simple("圆周3.14。对吗？\n\n“是。”他说") == ["圆周3.14。", "对吗？\n\n", "“是。”", "他说"]
    assert segment.split_markdown("# 题\n\n甲。乙。\n- 项\n") == ["# 题\n\n", "甲。", "乙。\n", "- 项\n"]


def test_cuts(spark):
    text = "\n".join("甲" * 30 for _ in range(40))
    assert all(len(x) <= 90 for x in segment.cut(text, 60)) and "".join(segment.cut(text, 60)).replace("\n", "") == text.replace("\n", "")
    assert segment.cut("", 60) == [] and segment.cut("甲。" * 100, 60)[0][-1] == "。"
    df = spark.createDataFrame([(1, "## 甲\n正文"), (2, None), (3, ""), (4, "前\n# 乙\n" + "丙。" * 500)], "doc_id long, text string")
    assert {r["doc_id"] for r in segment.chunks_with_context(df).collect()} == {1, 4}
    s = segment.sections(df, levels=(1, 2)).orderBy("doc_id", "section_idx").collect()
    assert [(r["doc_id"], r["title"], r["level"]) for r in s][:2] == [(1, "甲", 2), (3, None, 0)]
    assert [r["start_line"] for r in segment.sentences(df).where("doc_id = 1").orderBy("sent_idx").collect()] == [1, 2]


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "较对较对"), (2, None), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("较对", "校对"), ("对较", "?"), ("无", "有")], "word string, standard string")
    got = {(r["start_pos"], r["word"]) for r in lexicon.word_findings(docs, words).collect()}
    assert got == {(0, "较对"), (1, "对较"), (2, "较对")}
    assert {(r["start_pos"], r["word"]) for r in lexicon._by_join(docs, words, "doc_id", "text").collect()} == got
    kept = lexicon.resolve_overlaps(lexicon.word_findings(docs, words)).where("kept").collect()
    assert [r["start_pos"] for r in kept] == [0]
    assert lexicon.word_findings(docs, words.limit(0)).count() == 0


def test_replacements(spark):
    docs = spark.createDataFrame([(1, "甲乙丙丁"), (2, "戊"), (3, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 1, "子"), (1, 2, 2, "寅卯辰"), (1, 1, 2, "x"), (2, 5, 1, "y")], "doc_id long, start_pos int, length int, replacement string")
    got = {r["doc_id"]: (r["text"], r["applied"], r["dropped"]) for r in locate.apply_replacements(docs, edits).collect()}
    assert got == {1: ("子乙寅卯辰", 2, 1), 2: ("戊", 0, 1), 3: (None, 0, 0)}


def test_locate(spark):
    f = spark.createDataFrame([(1, 9, 1, "乙丙"), (2, 9, 1, "无此"), (3, 9, 7, "甲"), (4, 9, 1, " "), (5, 9, 2, "乙丙")], "finding_id int, book_id int, chunk_id int, original_sentence string")
    c = spark.createDataFrame([(1, 9, "甲乙丙乙丙"), (2, 9, "甲乙"), (3, 8, "乙丙")], "chunk_id int, book_id int, target string")
    got = locate.in_named_chunk(f, c)
    assert {r["finding_id"]: (r["outcome"], r["position"], r["occurrences"]) for r in got.collect()} == {1: ("located", 1, 2), 2: ("not_in_chunk", -1, 0), 3: ("p_out_of_range", -1, 0), 4: ("empty_key_text", -1, 0), 5: ("not_in_chunk", -1, 0)}
    book = locate.in_book(got.where("outcome in ('not_in_chunk', 'p_out_of_range')").select("finding_id", "book_id", "key"), c)
    assert {r["finding_id"]: (r["chunks"], r["chunk_id"]) for r in book.collect()} == {3: (2, 1), 5: (1, 1)}
    rng = random.Random(6)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(200)) for _ in range(12)]
    keys = [(n, n % 2, texts[n % 12][n : n + rng.randint(1, 40)]) for n in range(150)] + [(900, 0, "x" * 30)]
    many = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "chunk_id int, book_id int, target string")
    got = {r["finding_id"]: (r["chunks"], r["chunk_id"]) for r in locate.in_book(spark.createDataFrame(keys, "finding_id int, book_id int, key string"), many).collect()}
    want = {f: (len(at), at[0]) for f, book, key in keys if (at := [i for i, t in enumerate(texts) if i % 2 == book and key in t])}
    assert got == want
    ties = spark.createDataFrame([(1, 1, 90.0), (1, 2, 88.0), (2, 1, 90.0), (2, 2, 70.0)], "finding_id int, chunk_id int, ratio double")
    assert {r["finding_id"]: r["outcome"] for r in locate.clear_winner(ties).collect()} == {1: "fuzzy_tie", 2: "located"}


def test_ordered(spark):
    rows = [(k, d, n, d * 10 + n) for k in (1, None) for d in range(3) for n in range(4)]
    df = spark.createDataFrame(rows, "k int, d int, n int, v int")
    got = ordered.with_running_sum(ordered.with_previous(df, "k", F.col("d"), ["d", "n"], "v", "prev"), "k", F.col("d"), ["d", "n"], "v", "total").orderBy("k", "d", "n").collect()
    for key in (1, None):
        mine = [r for r in got if r["k"] == key]
        assert [r["prev"] for r in mine] == [None, *[r["v"] for r in mine[:-1]]]
        assert [r["total"] for r in mine] == [sum(x["v"] for x in mine[: i + 1]) for i in range(len(mine))]


def test_dictionary(spark):
    m = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4)], "k string, v string, seen int")
    assert [(r["k"], r["merged"]) for r in dictionary.merge_map(m).collect()] == [("a", "x；y")]
    f = spark.createDataFrame([(i, "v" if i % 7 == 3 else None) for i in range(50)], "i int, v string")
    filled = [r["v"] for r in dictionary.fill_down(f, ["i"], "v").orderBy("i").collect()]
    assert filled[:3] == [None] * 3 and set(filled[3:]) == {"v"}
    packed = spark.createDataFrame([("甲", None, "1"), ("乙", "号", "2"), ("乙", None, "3")], "head string, label string, raw string")
    assert dictionary.differences(dictionary.expand(dictionary.compact(packed)), packed).count() == 0
    d = spark.range(1).select(dictionary.life_dates(F.lit("荀况（约前313—前238），李白（701？—762）（注）")).alias("d")).first()["d"]
    assert [(x["name"], x["dates"]) for x in d] == [("荀况", "约前313—前238"), ("李白", "701？—762")]
