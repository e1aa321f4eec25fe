"""All found queries on small whole tables: nulls in any column, repeated rows, clashing extra columns, and no rows at all."""

import pytest

from quire.llm.queries import oracle_sql, queries

SCHEMAS = {
    "your_markdown": "chunk_id long, book_id long, chunk_idx int, kind string, profile string, target string, context string, reference string, tbl string, rec_id string, text string, markup string, field string, limit int, pad int, key string",
    "max_pipeline": "finding_id long, chunk_id long, book_id long, phase string, original_sentence string, corrected_sentence string, tbl string, rec_id string, text string, defect string",
    "documents": "doc_id long, text string, lang string, item long, bytes string, size string, salt string, rank string, parts string, item_id string, held string, letters string",
    "benchmark": "item_id long, lang string, text string, doc_id string",
    "split_settings": "profile string, cut_by int, context_pad int, max_context int, target string, context string, chunk_id string",
    "containers": "container_kind string, capacity int, item string, size string",
}
PASSAGE = "渡口封冻时芦花镇的印刷工晾晒了砚台令人费解采石人校对河道雨停之后又抄录凡例据说云台桥方圆五十里有粮仓二十座渐渐冷清无人知晓"
ROWS = {
    "your_markdown": [
        (1, 1, 0, "paragraph", "p", "# 题\n\n甲乙丙。丁戊？", "长" * 30, None),
        (1, 1, 0, "paragraph", "p", "# 题\n\n甲乙丙。丁戊？", "长" * 30, None),
        (2, 1, 1, "section", None, "Ａ甲​乙�", None, None),
        (3, None, None, None, None, None, None, None),
        (None, 1, 2, "paragraph", "q", "", "", ""),
    ],
    "max_pipeline": [(1, 1, 1, "x", "谁抄录了地地契？", None), (1, 1, 1, "x", "谁抄录了地地契？", None), (2, 1, 1, "x", "谁抄ｌ录了？", "谁抄录了。是谁。"), (3, None, None, None, None, None), (None, 1, 1, "x", "", "")],
    "documents": [(1, PASSAGE + PASSAGE, "zh"), (1, PASSAGE + PASSAGE, "zh"), (2, None, None), (3, "", "zh"), (None, "短", None)],
    "benchmark": [(1, "zh", PASSAGE), (2, None, None), (3, "zh", "")],
    "split_settings": [("p", 100, 2, 20), (None, 1, 1, 1), ("q", None, None, None)],
    "containers": [("k", 300), ("n", None), (None, 5)],
}
EXPECTED = {
    "p1_found": [(1, "empty"), (1, "empty"), (None, "empty")],
    "p2_found": [(1, "markdown"), (1, "markdown")],
    "p3_found": [(1, "context"), (1, "context")],
    "p4_found": [("max_pipeline", 2, 5), ("max_pipeline", 2, 8), ("your_markdown", 1, 3), ("your_markdown", 1, 3), ("your_markdown", 1, 9), ("your_markdown", 1, 9), ("your_markdown", 1, 12), ("your_markdown", 1, 12)],
    "p5_found": [(2,)],
    "p6_found": [("max_pipeline", 2), ("your_markdown", 2)],
    "p7_found": [(1, "k"), (1, "k")],
    "p8_found": [(1, 1), (1, 1)],
    "p9_found": [(1,), (1,)],
}


def write(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        width = len(schema.split(", "))
        filled = [(*r, *[None if f.split()[1] != "string" else "x" for f in schema.split(", ")[len(r) : width]]) for r in rows[name]]
        spark.createDataFrame(filled, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    write(spark, full, ROWS)
    write(spark, empty, {k: [] for k in ROWS})
    return full, empty


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_found(spark, folders, name):
    order = lambda r: tuple(str(x).zfill(9) for x in r)
    got = sorted((tuple(r) for r in queries()[name](spark, folders[0]).collect()), key=order)
    assert got == sorted(EXPECTED[name], key=order)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, folders, name):
    assert queries()[name](spark, folders[1]).count() == 0


def test_sql_is_of_queries():
    assert set(oracle_sql()) <= set(queries())
