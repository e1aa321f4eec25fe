import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import packing
from quire.llm.packing import finish, found, joined_ranks, pack, sizes


def fit_bins(items, cap):
    """First fit, largest first."""
    bins = []
    for s in sorted(items, reverse=True):
        for k, room in enumerate(bins):
            if room >= s:
                bins[k] -= s
                break
        else:
            bins.append(cap - s)
    return bins


def test_finish_is_sound_and_best_fit():
    rng = random.Random(1)
    for _ in range(300):
        cap = rng.randint(1, 60)
        items = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 120)))
        gaps = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 30)))
        used, seen = Counter(), Counter()
        for size, rank, width, which in finish(dict(items), dict(gaps), cap):
            assert rank == seen[size] and which < (gaps[width] or 10**9)
            seen[size] += 1
            used[width, which] += size
        assert seen == items and all(v <= (w or cap) for (w, _), v in used.items())
        if not gaps:
            assert len(used) <= len(fit_bins(list(items.elements()), cap)) + 1


def test_ranks_of_parts_match_like_one_sweep():
    rng = random.Random(3)
    for _ in range(300):
        left = [(0, part, rng.randint(0, 4), rng.randint(0, 4)) for part in range(6)]
        stack, want = [], set()
        for _, part, gaps, items in left:
            want |= {(part, k, *stack.pop()) for k in range(items) if stack}
            stack += [(part, k) for k in range(gaps)]
        got = {(ip, first + k, gp, last - k) for _, ip, first, many, gp, last in joined_ranks(left) for k in range(many)}
        assert got == want


def test_pack(spark):
    items = spark.createDataFrame([(1, 5), (2, 0), (3, 25), (4, 10), (5, 20), (6, None), (7, 5), (7, 5)], "item long, bytes long")
    kinds = spark.createDataFrame([("k", 10), ("none", 0), (None, 5), ("k", 10)], "container_kind string, capacity int")
    got = pack(items, kinds).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["item"], []).append((r["part"], r["part_bytes"], r["parts"]))
    assert sorted(parts[3]) == [(0, 10, 3), (1, 10, 3), (2, 5, 3)] and sorted(parts[5]) == [(0, 10, 2), (1, 10, 2)]
    assert parts[4] == [(0, 10, 1)] and len(parts[7]) == 2 and 6 not in parts and parts[2] == [(0, 0, 1)]
    fill = Counter()
    for r in got:
        fill[r["container_id"] if r["container_id"] >= 0 else (r["item"], r["part"])] += r["part_bytes"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 70 and len([v for v in fill.values() if v]) == 7
    assert pack(items.limit(0), kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0


def test_equal_sizes_share_no_place(spark):
    items = spark.range(5000).select(F.col("id").alias("item"), F.lit(3).cast("long").alias("bytes"))
    got = pack(items, spark.createDataFrame([("k", 10)], "container_kind string, capacity int"))
    assert got.groupBy("container_id").agg(F.sum("part_bytes").alias("n")).agg(F.max("n"), F.count("*")).first()[:] == (9, 1667)


def test_found(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 6, "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 10, "x")], "doc_id long, text string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("k", 10)], "container_kind string, capacity int").write.parquet(str(tmp_path / "containers.parquet"))
    assert [tuple(r) for r in found(spark, str(tmp_path)).collect()] == [(1, "k")]
    assert sizes(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 3


def packed(spark, bytes_, cap, monkeypatch, finish_at):
    monkeypatch.setattr(packing, "FINISH", finish_at)
    items = spark.createDataFrame(list(enumerate(bytes_)), "item long, bytes long").repartition(4)
    rows = pack(items, spark.createDataFrame([("k", cap)], "container_kind string, capacity int")).where("container_id >= 0").collect()
    assert sorted((r["item"], r["part_bytes"]) for r in rows) == [(k, n) for k, n in enumerate(bytes_)]
    used = Counter()
    for r in rows:
        used[r["container_id"]] += r["part_bytes"]
    assert max(used.values()) <= cap
    return len(used)


@pytest.mark.parametrize("shape", ["mixed", "equal"])
def test_supersteps_place_everything(spark, monkeypatch, shape):
    rng = random.Random(4)
    sizes_ = {"mixed": [min(500, int(rng.lognormvariate(4.5, 0.9)) + 1) for _ in range(1500)], "equal": [3] * 800}[shape]
    n = packed(spark, sizes_, 500, monkeypatch, 60)
    assert n <= 1.06 * len(fit_bins(sizes_, 500)) + 1


def test_oversized_rests_come_through_the_sweeps(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a" * 25), (2, "b" * 7), (3, "c" * 20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("k", 10)], "container_kind string, capacity int").write.parquet(str(tmp_path / "containers.parquet"))
    assert sorted(tuple(r) for r in found(spark, str(tmp_path)).collect()) == [(1, "k"), (3, "k")]
    monkeypatch.setattr(packing, "place", lambda units, _: units.where("false").select("kx", "id", F.lit(0).alias("place")))
    assert [tuple(r) for r in found(spark, str(tmp_path)).collect()] == [(3, "k")]  # without the packing the rest of 1 is lost
