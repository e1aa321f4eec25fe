import random

from quire.operators.align import Sentences, align, by_anchors, by_similarity, exact, exact_items, statistics, validation

LETTERS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"


def pair(rng):
    sentence = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(8, 40)))
    a = [sentence() for _ in range(rng.randint(0, 20))]
    b = [x if rng.random() < 0.6 else x[:-3] + sentence()[:4] for x in a if rng.random() < 0.9]
    for _ in range(3):
        b.insert(rng.randrange(len(b) + 1), rng.choice(a) if a and rng.random() < 0.3 else sentence())
    return a, b


def test_every_sentence_is_used_once_in_every_stage():
    rng = random.Random(3)
    for _ in range(150):
        a, b = pair(rng)
        for name, items in [*by_anchors(a, b), ("similarity", by_similarity(a, b)), ("exact", exact_items(Sentences(a, b)))]:
            kept = [x for x in items if x.kind != "movein"]
            assert sorted(i for x in kept for i in x.a) == list(range(len(a))), name
            assert sorted(j for x in kept for j in x.b) == list(range(len(b))), name


def test_moved_sentence():
    a = ["甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未", "天地玄黄宇宙洪荒", "日月盈昃辰宿列张", "寒来暑往秋收冬藏"]
    kinds = [x.kind for x in by_anchors(a, [a[1], a[2], a[3], a[4], a[0]])[-1][1]]
    assert kinds.count("moveout") == kinds.count("movein") == 1 and kinds.count("match") == 4


def test_merged_sentence_is_rematched():
    a = ["甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未天地玄黄", "日月盈昃辰宿列张"]
    items = by_anchors(a, [a[0], a[1] + a[2]])[-1][1]
    assert [(x.kind, x.a, x.b) for x in items] == [("match", [0], [0]), ("match", [1, 2], [1])]


def test_exact_agrees_with_the_plain_form(spark):
    rng = random.Random(5)
    pairs = [pair(rng) for _ in range(25)] + [(["同"] * 3, ["同"] * 2), ([], ["新"]), (["旧"], [])]
    side = lambda k: spark.createDataFrame([(n, i, t) for n, p in enumerate(pairs) for i, t in enumerate(p[k])], "pair_id int, idx int, text string")
    got = {}
    for r in exact(side(0), side(1)).orderBy("pair_id", "seq").collect():
        got.setdefault(r["pair_id"], []).append((r["type"], r["a_index"], r["b_index"]))
    for n, (a, b) in enumerate(pairs):
        want = [(x.kind, x.a[0] if x.a else -1, x.b[0] if x.b else -1) for x in exact_items(Sentences(a, b))]
        assert got.get(n, []) == want


def test_grouped(spark):
    rows = [(1, "a", 0, "一二三四五六"), (1, "b", 0, "一二三四五六"), (1, "a", 1, None), (2, "a", 0, "甲乙丙丁"), (2, "b", 5, "  ")]
    df = spark.createDataFrame(rows, "pair_id long, side string, idx long, text string")
    got = align(df)
    assert {(r["pair_id"], r["type"]) for r in got.collect()} == {(1, "match"), (2, "delete")}
    assert statistics(got).where("pair_id = 1").first()["match"] == 1
    assert align(df.limit(0)).count() == 0
    used = spark.createDataFrame([(1, 0), (1, 0)], "pair_id int, idx int")
    have = spark.createDataFrame([(1, 0), (1, 1)], "pair_id int, idx int")
    assert {(r["idx"], r["times"]) for r in validation(used, have).collect()} == {(0, 2), (1, 0)}
