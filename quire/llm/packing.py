"""Problem 7: items of varying length into containers of fixed capacity.

Bulk-synchronous best fit. The unplaced items and the gaps of the open containers are rows of one table. A superstep
sorts them by range, widest first, and sweeps: every item takes its successor, the smallest gap still free that
holds it, and of the items that want one gap the larger one goes first. The sweep matches like parentheses, so
each part of the sorted order matches its own rows alone, and what is left over in a part meets the other parts by rank:
how many gaps and items each part has left tells which ranks belong together. Then gaps are updated, containers are opened for
items that no gap holds, and the next superstep begins.

Small items travel in bundles of up to half the widest gap, so that a superstep fills a gap by a share of its room and not by
one item; a bundle that finds no gap comes apart again. Smaller items wait while larger ones fill the gaps. So the number of
supersteps hardly depends on the number of items, and once no more than FINISH items of a kind are left, they are placed one by one.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

FINISH = 4000  # items of a kind from which on they are placed one by one, planned on the driver

SALTS = 64  # parts in which the gaps of one width are ranked at the end

#: Container kinds are settings; their list becomes a literal of the query.
MAX_KINDS = 1000

#: Rows of the state: gaps, unplaced items, placed items (with their container in ``place``).
GAP, ITEM, PLACED = 0, 1, 2
STATE = "kx int, t int, id long, w int, place long"
BUNDLES = "kx int, w int, ids array<long>, sizes array<int>"
SWEPT = "t int, kx int, part int, rank int, id long, w int, ids array<long>, sizes array<int>"

Histogram = dict[int, int]  # width or size -> how many


def bundles(items: DataFrame, room: dict[int, int]) -> DataFrame:
    """Consecutive items of the range-sorted order in bundles of at most ``room`` of their kind; larger items go alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total, ids, sizes = None, 0, [], []
        out: list[tuple] = []
        for batch in batches:
            for kx, size, u in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (kx != kind or total + size > room[kx]):
                    out.append((kind, total, ids, sizes))
                    total, ids, sizes = 0, [], []
                kind, total = kx, total + size
                ids.append(u)
                sizes.append(size)
            if len(out) > 10_000:
                yield _batch(out, BUNDLES)
                out = []
        if ids:
            out.append((kind, total, ids, sizes))
        if out:
            yield _batch(out, BUNDLES)

    order = [F.col("kx"), F.col("w").desc(), F.col("id")]
    return items.repartitionByRange(*order).sortWithinPartitions(*order).select("kx", "w", "id").mapInArrow(run, BUNDLES)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def sweep(gaps: DataFrame, offered: DataFrame) -> DataFrame:
    """One pass over gaps and bundles, widest first, in the parts of a range sort.

    Rows: matches (``t`` PLACED, ``id`` the container, ``w`` the gap that remains), and what found no partner in its
    part with its rank there (GAP or ITEM).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        free: list[tuple] = []
        kind, waiting = None, 0
        out: list[tuple] = []
        for batch in batches:
            for kx, w, t, u, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if kx != kind:
                    out += [(GAP, kind, part, k, g, gw, None, None) for k, (g, gw) in enumerate(free)]
                    kind, waiting, free = kx, 0, []
                if t == GAP:
                    free.append((u, w))
                elif free:
                    g, gw = free.pop()
                    out.append((PLACED, kx, part, 0, g, gw - w, ids, sizes))
                else:
                    out.append((ITEM, kx, part, waiting, 0, w, ids, sizes))
                    waiting += 1
            if len(out) > 10_000:
                yield _batch(out, SWEPT)
                out = []
        out += [(GAP, kind, part, k, g, gw, None, None) for k, (g, gw) in enumerate(free)]
        if out:
            yield _batch(out, SWEPT)

    none = F.lit(None)
    rows = gaps.select("kx", "w", "t", "id", none.cast("array<long>").alias("ids"), none.cast("array<int>").alias("sizes"))
    rows = rows.unionByName(offered.select("kx", "w", F.lit(ITEM).alias("t"), F.element_at("ids", 1).alias("id"), "ids", "sizes"))
    order = [F.col("kx"), F.col("w").desc(), F.col("t"), F.col("id")]  # with the id, rows of one width are split like others
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def joined_ranks(left: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which leftover gaps and items of the parts belong together: ``(kx, item part, first rank, items, gap part, last rank)``.

    ``left``: (kx, part, gaps, items) of each part. The items of a part precede its gaps and take the last free gaps of the parts before.
    """
    pieces, free, kind = [], [], None
    for kx, part, gaps, items in sorted(left):
        if kx != kind:
            kind, free = kx, []
        rank = 0
        while rank < items and free:
            whose, many = free.pop()
            use = min(many, items - rank)
            pieces.append((kx, part, rank, use, whose, many - 1))
            rank += use
            if use < many:
                free.append((whose, many - use))
        if gaps:
            free.append((part, gaps))
    return pieces


def _per_kind(values: dict[int, int]) -> Column:
    """The value of a row's kind, null for other kinds."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("kx")]


def superstep(state: DataFrame, room: dict[int, int], least: dict[int, int]) -> DataFrame:
    """The state after one superstep: of each kind in ``room``, items of ``least`` or more were offered in bundles of ``room``."""
    state = state.withColumn("least", _per_kind(least))
    gap, none = F.col("t") == GAP, F.lit(None).cast("long").alias("place")
    offered = F.coalesce(F.col("w") >= F.col("least"), F.lit(False))
    swept = cut(sweep(state.where(gap & F.col("least").isNotNull()).select("kx", "w", "t", "id"), bundles(state.where(~gap & offered).select("kx", "w", "id"), room)))
    left = [tuple(r) for r in swept.where(F.col("t") != PLACED).groupBy("kx", "part").agg(F.count_if(gap), F.count_if(F.col("t") == ITEM)).collect()]  # one row per part and kind
    pieces = [(n, *p) for n, p in enumerate(joined_ranks(left))]
    p = F.broadcast(state.sparkSession.createDataFrame(pieces, "piece int, pk int, ipart int, first int, many int, gpart int, last int").coalesce(1))
    kind, rank = F.col("kx") == F.col("pk"), F.col("rank")
    g = swept.where(gap).join(p, kind & (F.col("part") == F.col("gpart")) & (rank <= F.col("last")) & (rank > F.col("last") - F.col("many")), "left")
    b = swept.where(F.col("t") == ITEM).join(p, kind & (F.col("part") == F.col("ipart")) & (rank >= F.col("first")) & (rank < F.col("first") + F.col("many")), "left")
    met = g.where("piece is not null").select("piece", (F.col("last") - rank).alias("k"), "id", F.col("w").alias("gap"))
    met = met.join(b.where("piece is not null").select("piece", (rank - F.col("first")).alias("k"), "kx", "w", "ids", "sizes"), ["piece", "k"])
    met = met.select("kx", "id", (F.col("gap") - F.col("w")).alias("w"), "ids", "sizes").unionByName(swept.where(F.col("t") == PLACED).select("kx", "id", "w", "ids", "sizes"))
    # a match gives its gap, if room is left, and its items; what found none stays as it is
    row = lambda t, i, w, where: F.struct(F.lit(t).alias("t"), i.cast("long").alias("id"), w.cast("int").alias("w"), where.cast("long").alias("place"))
    items = lambda t, where: F.transform(F.arrays_zip("ids", "sizes"), lambda x: row(t, x["ids"], x["sizes"], where))
    remains = F.when(F.col("w") > 0, F.array(row(GAP, F.col("id"), F.col("w"), F.lit(None)))).otherwise(F.array())
    now = met.select("kx", F.inline(F.concat(items(PLACED, F.col("id")), remains)))
    now = now.unionByName(b.where("piece is null").select("kx", F.inline(items(ITEM, F.lit(None)))))
    now = now.unionByName(g.where("piece is null").select("kx", "t", "id", "w", none))
    return cut(now.unionByName(state.where(F.col("least").isNull() | ~gap & ~offered).select("kx", "t", "id", "w", "place")))


def finish(items: Histogram, gaps: Histogram, capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit of the last items, largest first: ``(size, rank, width, which)``.

    The item of that size and rank goes into the ``which``-th gap of that width, or with width 0 into the ``which``-th new container.
    """
    plan, opened = [], 0
    whole = dict(gaps)  # untouched gaps by width
    used: list[tuple[int, int, int]] = []  # (room left, width, which) of gaps already touched
    widths = sorted(whole)
    taken = dict.fromkeys(widths, 0)
    for size in sorted(items, reverse=True):
        for rank in range(items[size]):
            at, k = bisect_left(widths, size), bisect_left(used, (size,))
            if k < len(used) and (at == len(widths) or used[k][0] <= widths[at]):
                room, width, which = used.pop(k)
            elif at < len(widths):
                room = width = widths[at]
                which = taken[width]
                taken[width] += 1
                if taken[width] == whole[width]:
                    del widths[at]
            else:
                room, width, which, opened = capacity, 0, opened, opened + 1
            plan.append((size, rank, width, which))
            if room > size:
                insort(used, (room - size, width, which))
    return plan


def _room(items: Histogram, gaps: Histogram) -> tuple[int, int]:
    """``(room of a bundle, least size offered)``.

    Where items of more than half that room are as many as the gaps of more than half of it, only those are offered, so that no bundle of
    smaller ones takes their gaps; else the largest items that fill what one bundle a gap can take.
    """
    room = max(gaps) // 2 or 1
    if sum(n for s, n in items.items() if 2 * s > room) >= sum(n for w, n in gaps.items() if 2 * w > room):
        return room, room // 2 + 1
    want = sum(n * min(w, room) for w, n in gaps.items() if w >= min(items))
    for size in sorted(items, reverse=True):
        want -= size * items[size]
        if want <= 0:
            return room, size
    return room, min(items)


def place(units: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """``kx, id, place`` of all units (kx, id, w), with ``0 < w <= capacities[kx]``; ``id`` is unique within a kind."""
    spark = units.sparkSession
    state = cut(units.select("kx", F.lit(ITEM).alias("t"), "id", "w", F.lit(None).cast("long").alias("place")))
    opened, placed = dict.fromkeys(capacities, 0), []
    while True:
        counts: dict[tuple[int, int], Histogram] = {(k, t): {} for k in capacities for t in (GAP, ITEM)}
        for r in state.where(F.col("t") != PLACED).groupBy("kx", "t", "w").count().collect():  # at most twice the capacity of each kind
            counts[r["kx"], r["t"]][r["w"]] = r["count"]
        fresh, active, last, closed = None, {}, {}, {}
        for k, capacity in capacities.items():
            items, gaps = counts[k, ITEM], counts[k, GAP]
            if not items:
                continue
            closed[k] = min(items)
            if sum(items.values()) <= FINISH:
                last[k] = finish(items, gaps, capacity)
                continue
            widest = max(gaps, default=0)
            homeless = sum(s * n for s, n in items.items() if s > widest)
            if homeless:
                more = -(-homeless // capacity)
                rows = spark.range(opened[k], opened[k] + more).select(F.lit(k).alias("kx"), F.lit(GAP).alias("t"), "id", F.lit(capacity).alias("w"), F.lit(None).cast("long").alias("place"))
                fresh = rows if fresh is None else fresh.unionByName(rows)
                opened[k] += more
                gaps[capacity] = gaps.get(capacity, 0) + more
            active[k] = _room(items, {w: n for w, n in gaps.items() if w >= closed[k]})
        if not active:
            break
        now = state.where((F.col("t") != PLACED) & ((F.col("t") == ITEM) | (F.col("w") >= _per_kind(closed))))
        state = superstep(now if fresh is None else now.unionByName(fresh), {k: v[0] for k, v in active.items()}, {k: v[1] for k, v in active.items()})
        placed.append(state.where(F.col("t") == PLACED))
    done = state.where("false").select("kx", "id", "place")
    for p in placed:
        done = done.unionByName(p.select("kx", "id", "place"))
    rows = [(k, *p) for k, plan in last.items() for p in plan]  # at most FINISH rows a kind
    if rows:
        plan = spark.createDataFrame(rows, "kx int, w int, rank int, width int, which int")
        ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("kx", "w", *by).orderBy("id")) - 1)
        items = ranked(state.where(F.col("t") == ITEM).select("kx", "w", "id")).join(F.broadcast(plan), ["kx", "w", "rank"]).select("kx", "id", "width", "which")
        # of the gaps of one width, of which there may be any number, each part gives as many as the plan takes
        taken = F.broadcast(plan.where("width > 0").groupBy("kx", F.col("width").alias("w")).agg(F.count_distinct("which").alias("many")))
        gaps = state.where(F.col("t") == GAP).join(taken, ["kx", "w"]).select("kx", "w", "id", "many", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        gaps = ranked(ranked(gaps, "salt").where("rank < many").drop("rank")).where("rank < many")
        into = items.join(gaps.select("kx", F.col("w").alias("width"), F.col("rank").alias("which"), F.col("id").alias("place")), ["kx", "width", "which"], "left")
        done = done.unionByName(into.select("kx", "id", F.coalesce("place", _per_kind(opened) + F.col("which")).alias("place")))
    return done


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(item, bytes)``: ByT5 tokens are UTF-8 bytes, counted in the JVM. A null text is no item."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.octet_length(F.col(text_col)).cast("long").alias("bytes"))


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Assigns every item, or every part of an oversized item, to a container of each kind.

    ``items``: (item, bytes); ``containers``: (container_kind, capacity). Returns
    ``item, container_kind, bytes, parts, part, part_bytes, container_id``. An item larger than the
    capacity is cut into full parts, each filling a container by itself (``container_id`` is then
    ``-1 - part`` of that item, unique with the item), and a rest that is packed like any item; smaller items
    are never cut. Null sizes, null or non-positive capacities yield no rows; size 0 is an item that takes no
    room and goes into container 0; repeated rows are items of their own. Empty inputs give an empty result.

    The items are read once and cut by a checkpoint, as is the state after each superstep; the supersteps run when
    this is called. The driver sees histograms of sizes and gaps (bounded by the capacities) and counts of parts.
    """
    kinds = containers.where("capacity > 0 and container_kind is not null").select("container_kind", F.col("capacity").cast("int")).dropDuplicates(["container_kind"]).orderBy("container_kind").take(MAX_KINDS + 1)
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    items = cut(items.where(F.col("bytes").isNotNull()).select("item", "bytes").withColumn("id", F.monotonically_increasing_id()))
    struct = "array<struct<kx:int,container_kind:string,capacity:int>>"
    each = items.select("item", "bytes", "id", F.inline(F.from_json(F.lit(json.dumps([{"kx": n, **k.asDict()} for n, k in enumerate(kinds)])), struct)))
    full = (F.col("bytes") / F.col("capacity")).cast("long")
    rest = (F.col("bytes") - full * F.col("capacity")).cast("int")
    each = each.withColumn("full", F.when(F.col("bytes") > F.col("capacity"), full).otherwise(F.lit(0)).cast("long"))
    each = each.withColumn("size", F.when(F.col("full") > 0, rest).otherwise(F.col("bytes").cast("int")))
    each = each.withColumn("parts", F.col("full") + F.when((F.col("full") == 0) | (F.col("size") > 0), 1).otherwise(0))

    placed = place(each.where("size > 0").select("kx", "id", F.col("size").alias("w")), {n: k["capacity"] for n, k in enumerate(kinds)})
    out = lambda df, part, size, where: df.select("item", "container_kind", "bytes", "parts", part.alias("part"), size.cast("long").alias("part_bytes"), where.cast("long").alias("container_id"))
    packed = out(each.where("size > 0").join(placed, ["kx", "id"]), F.col("parts") - 1, F.col("size"), F.col("place"))
    nothing = out(each.where("full = 0 and size = 0"), F.lit(0).cast("long"), F.lit(0), F.lit(0))
    whole = each.where("full > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    return packed.unionByName(nothing).unionByName(out(whole, F.col("part"), F.col("capacity"), -1 - F.col("part")))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sizes(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "containers"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the packing had to cut, by kind, each by the last of its parts: mostly the rest that went through the sweeps."""
    return assignment(spark, sf_dir).where((F.col("parts") > 1) & (F.col("part") == F.col("parts") - 1)).select(F.col("item").alias("doc_id"), "container_kind")


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each kind."""
    cap = table(spark, sf_dir, "containers").select("container_kind", F.col("capacity").cast("long").alias("capacity"))
    a = assignment(spark, sf_dir)
    shared = a.where(F.col("container_id") >= 0).groupBy("container_kind", "container_id").agg(F.sum("part_bytes").alias("used"))
    alone = a.where(F.col("container_id") < 0).select("container_kind", F.lit(-1).cast("long").alias("container_id"), F.col("part_bytes").alias("used"))
    t = shared.unionByName(alone).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return t.join(F.broadcast(cap), "container_kind").select("container_kind", "containers", "tokens", "fullest", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"))
