"""Alignment of two versions' sentences: exact by joins, by anchors and by similarity within each pair.

Alignments are rows ``pair_id, seq, type, a_indices, b_indices, similarity``; types are match, delete, insert, and for
moved sentences moveout (where it was) and movein (where it is).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

ALIGNMENT = "pair_id {key}, stage string, seq int, type string, a_indices array<int>, b_indices array<int>, similarity double"


# Exact alignment, as joins and windows


def exact(a: DataFrame, b: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``pair_id, seq, type, a_index, b_index``: the k-th occurrence of a sentence pairs with its k-th occurrence.

    ``a``, ``b``: (pair_id, idx, text). Blanks don't count; blank sentences and nulls are left out. An index that a row
    lacks is -1. Matches and deletes come in a's order; an insert follows the match of the nearest earlier b, or comes
    before the first match, or last.
    """

    def numbered(side: DataFrame, name: str) -> DataFrame:
        n = side.select(pair, F.col("idx").alias(name), T.squeeze(F.col("text")).alias("norm")).where("norm <> ''")
        return n.withColumn("k", F.row_number().over(Window.partitionBy(pair, "norm").orderBy(name)))

    j = numbered(a, "a_index").join(numbered(b, "b_index"), [pair, "norm", "k"], "full").drop("norm", "k")
    by_b = Window.partitionBy(pair).orderBy(F.col("b_index").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    match_a = F.when(F.col("b_index").isNotNull(), F.col("a_index"))
    j = j.withColumn("base", F.last(match_a, ignorenulls=True).over(by_b))
    first = F.min(F.when(F.col("a_index").isNotNull() & F.col("b_index").isNotNull(), F.struct("b_index", "a_index"))).over(Window.partitionBy(pair))
    j = j.withColumn("first", first["a_index"])
    insert = F.col("a_index").isNull()
    key = [F.when(~insert, F.col("a_index")).otherwise(F.coalesce("base", "first", F.lit(2**31 - 1))), F.when(~insert, 0).when(F.col("base").isNotNull() | F.col("first").isNull(), 1).otherwise(-1), F.when(insert, F.col("b_index")).otherwise(0)]
    kind = F.when(insert, "insert").when(F.col("b_index").isNull(), "delete").otherwise("match")
    seq = F.row_number().over(Window.partitionBy(pair).orderBy(*key)) - 1
    return j.select(pair, seq.alias("seq"), kind.alias("type"), F.coalesce("a_index", F.lit(-1)).alias("a_index"), F.coalesce("b_index", F.lit(-1)).alias("b_index"))


def units(alignment: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``pair_id, unit, type, from_seq, to_seq, sentences``: maximal runs of deletes and of inserts."""
    w = Window.partitionBy(pair).orderBy("seq")
    new = F.when(F.lag("type").over(w).eqNullSafe(F.col("type")), 0).otherwise(1)
    runs = alignment.withColumn("_new", new).withColumn("unit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.where("type in ('delete', 'insert')").groupBy(pair, "unit", "type").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("sentences"))


def statistics(alignment: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Items in all and of each known type."""
    kinds = ("match", "delete", "insert", "movein", "moveout")
    return alignment.groupBy(pair).agg(F.count("*").alias("total"), *(F.count_if(F.col("type") == k).alias(k) for k in kinds))


def validation(used: DataFrame, sentences: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``pair_id, idx, times``: sentences that an alignment doesn't use exactly once. ``used``, ``sentences``: (pair_id, idx)."""
    n = sentences.select(pair, "idx", F.lit(0).alias("n")).unionByName(used.select(pair, "idx", F.lit(1).alias("n")))
    return n.groupBy(pair, "idx").agg(F.sum("n").alias("times")).where("times <> 1")


# Alignment by anchors, within one pair


@dataclass
class Item:
    kind: str
    a: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    similarity: float = 0.0


class Sentences:
    """The two versions of a pair, normalized, with their n-grams kept."""

    def __init__(self, a: list[str], b: list[str], n: int = 2) -> None:
        self.a, self.b, self.n = ["".join(x.split()) for x in a], ["".join(x.split()) for x in b], n
        self.kept: dict[str, frozenset[str]] = {}

    def grams(self, text: str) -> frozenset[str]:
        if (g := self.kept.get(text)) is None:
            g = self.kept[text] = frozenset(text[k : k + self.n] for k in range(len(text) - self.n + 1)) or frozenset((text,))
        return g

    def alike(self, x: str, y: str) -> float:
        """Jaccard similarity of the n-grams: 0 if one is empty, 1 if they are equal."""
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        g, h = self.grams(x), self.grams(y)
        common = len(g & h)
        return common / (len(g) + len(h) - common)

    def of(self, item: Item) -> float:
        return self.alike("".join(self.a[i] for i in item.a), "".join(self.b[i] for i in item.b))


SOFT, HINT = 0.3, 0.5  # similarity that moves the anchor without a match, and that asks for a search of the whole


def scan(s: Sentences, window: int = 10, threshold: float = 0.6, offset: int = 1, widest: int = 3, patience: int = 3) -> list[Item]:
    """Greedy scan: each a takes the most similar free b near the anchor, which follows the matches.

    After ``patience`` misses the window grows, and when it misses badly all of b is searched. What is left of b goes
    behind the nearest earlier b that is placed, or to the end.
    """
    free = [True] * len(s.b)

    def best(x: str, span: range) -> tuple[int, float]:
        top, at = 0.0, -1
        for j in span:
            if free[j] and (r := s.alike(x, s.b[j])) > top:
                top, at = r, j
        return at, top

    items: list[Item] = []
    anchor = misses = 0
    for i, x in enumerate(s.a):
        reach = window if misses < patience else window * min(widest, 1 + (misses - patience) // 2)
        j, r = best(x, range(max(0, anchor - reach), min(len(s.b), anchor + reach + 1)))
        if r < threshold and (misses >= patience or reach >= 2 * window or r > HINT and misses >= 1):
            if (other := best(x, range(len(s.b))))[1] > r:
                j, r = other
        if j >= 0 and r >= threshold:
            free[j] = False
            items.append(Item("match", [i], [j], r))
            anchor, misses = j + offset, 0
        else:
            items.append(Item("delete", [i]))
            anchor, misses = max(anchor, j) if r > SOFT else anchor, misses + 1
    place = {item.b[0]: item for item in items if item.b}
    behind: dict[int, list[Item]] = {}
    last: list[Item] = []
    latest: Item | None = None
    for j in range(len(s.b)):
        if j in place:
            latest = place[j]
        elif latest is None:
            last.append(Item("insert", b=[j]))
        else:
            behind.setdefault(id(latest), []).append(Item("insert", b=[j]))
    return [x for item in items for x in (item, *behind.get(id(item), ()))] + last


def _runs(items: list[Item]) -> Iterator[tuple[int, int]]:
    """Maximal stretches of deletes and inserts."""
    k = 0
    while k < len(items):
        j = k
        while j < len(items) and items[j].kind in ("delete", "insert"):
            j += 1
        if j > k:
            yield k, j
        k = j + 1


def rematch_adjacent(s: Sentences, items: list[Item], threshold: float = 0.6) -> list[Item]:
    """Within each stretch, pairs deletes and inserts, also two neighbours as one where a side has three or fewer.

    Larger candidates come first and take the most similar partner; a sentence is used once.
    """
    out, done = [], 0
    for low, high in _runs(items):
        out += items[done:low]
        done = high
        dels = [x for x in items[low:high] if x.kind == "delete"]
        adds = [x for x in items[low:high] if x.kind == "insert"]
        pairs = lambda n: [(k, k + 1) for k in range(n - 1)] if n <= 3 else []
        left = pairs(len(dels)) + [(k,) for k in range(len(dels))]
        right = (pairs(len(adds)) if len(adds) == len(dels) else []) + [(k,) for k in range(len(adds))]
        used_d: set[int] = set()
        used_a: set[int] = set()
        made: dict[int, Item] = {}
        for d in left:
            top = Item("match", [i for k in d for i in dels[k].a])
            taken: tuple[int, ...] = ()
            for c in right:
                if used_d & {*d} or used_a & {*c}:
                    continue
                trial = Item("match", top.a, [j for k in c for j in adds[k].b])
                if (r := s.of(trial)) >= threshold and r > top.similarity:
                    top, taken = replace(trial, similarity=r), c
            if taken:
                used_d |= {*d}
                used_a |= {*taken}
                made[d[0]] = top
        number = {id(x): k for k, x in enumerate(dels)} | {id(x): k for k, x in enumerate(adds)}
        for x in items[low:high]:
            k = number[id(x)]
            if x.kind == "delete" and k in made:
                out.append(made[k])
            elif k not in (used_d if x.kind == "delete" else used_a):
                out.append(x)
    return out + items[done:]


def rematch_distant(s: Sentences, items: list[Item], threshold: float = 0.6, reach: int = 10) -> list[Item]:
    """Pairs a delete with the most similar free insert at most ``reach`` away by index or by place."""
    adds = [(p, x) for p, x in enumerate(items) if x.kind == "insert"]
    gone: set[int] = set()
    made: dict[int, Item] = {}
    for p, x in sorted(((p, x) for p, x in enumerate(items) if x.kind == "delete"), key=lambda t: t[1].a[0]):
        top, at = 0.0, -1
        for q, y in adds:
            if q not in gone and (abs(x.a[0] - y.b[0]) <= reach or abs(p - q) <= reach):
                if (r := s.of(Item("match", x.a, y.b))) >= threshold and r > top:
                    top, at = r, q
        if at >= 0:
            gone.add(at)
            made[p] = Item("match", x.a, items[at].b, top)
    return [made.get(p, x) for p, x in enumerate(items) if p not in gone]


def absorb(s: Sentences, items: list[Item], kind: str) -> list[Item]:
    """Folds lone deletes or inserts into the match beside them where that makes it more similar.

    An insert is also folded where it continues what the match's other side already says. Matches change as the
    pass goes on, so a later item meets the grown match.
    """
    out = [replace(x, a=list(x.a), b=list(x.b)) for x in items]
    k = 0
    while k < len(out):
        x = out[k]
        if x.kind == kind:
            best, at = None, -1
            for q in (k - 1, k + 1):
                if not 0 <= q < len(out) or out[q].kind != "match":
                    continue
                y = out[q]
                grown = Item("match", sorted(y.a + x.a), sorted(y.b + x.b))
                r = s.of(grown)
                said = "".join(s.b[j] for j in x.b)
                theirs = "".join(s.a[i] for i in y.a)
                carries = kind == "insert" and said and (theirs.endswith(said) if q < k else theirs.startswith(said))
                if (r > y.similarity or carries) and (best is None or r > best.similarity):
                    best, at = replace(grown, similarity=r), q
            if best:
                out[at] = best
                del out[k]
                continue
        k += 1
    return out


def movements(items: list[Item], rounds: int = 100) -> list[Item]:
    """Turns matches that left their order into moveout and movein.

    Matches whose b runs on form blocks. Again and again one of the smallest blocks that two blocks, or else one,
    can take in is moved beside them, where the joined block is largest.
    """
    live = [(p, x.b[0]) for p, x in enumerate(items) if x.kind == "match" and len(x.b) == 1]
    moved: list[tuple[int, int]] = []  # place of the item, place before which it moves
    for _ in range(rounds):
        blocks: list[list[tuple[int, int]]] = []
        for p, j in live:
            if blocks and blocks[-1][-1][1] + 1 == j:
                blocks[-1].append((p, j))
            else:
                blocks.append([(p, j)])
        if len(blocks) <= 1:
            break
        starts = {b[0][1]: b for b in blocks}
        ends = {b[-1][1]: b for b in blocks}
        least = min(map(len, blocks))
        for small in (b for b in blocks if len(b) == least):
            after, before = ends.get(small[0][1] - 1), starts.get(small[-1][1] + 1)
            if after and before:
                target = before[0][0]
            elif before and (not after or len(before) >= len(after)):
                target = before[0][0]
            elif after:
                target = after[-1][0] + 1
            else:
                continue
            moved += [(p, target) for p, _ in small]
            live = [x for x in live if x not in small]
            break
        else:
            break
    gone = {p for p, _ in moved}
    comes: dict[int, list[Item]] = {}
    for p, target in moved:
        comes.setdefault(target, []).append(replace(items[p], kind="movein"))
    out = []
    for p in range(len(items) + 1):
        out += comes.get(p, [])
        if p < len(items):
            out.append(replace(items[p], kind="moveout") if p in gone else items[p])
    return out


def by_anchors(a: list[str], b: list[str], threshold: float = 0.6, **settings) -> list[tuple[str, list[Item]]]:
    """The alignment after each stage."""
    s = Sentences(a, b)
    stages = [("scan", scan(s, threshold=threshold, **settings))]
    for name, step in (
        ("adjacent", lambda x: rematch_adjacent(s, x, threshold)),
        ("distant", lambda x: rematch_distant(s, x, threshold)),
        ("absorb", lambda x: absorb(s, absorb(s, x, "delete"), "insert")),
        ("moves", movements),
    ):
        stages.append((name, step(stages[-1][1])))
    return stages


def by_similarity(a: list[str], b: list[str], threshold: float = 0.6, gap: int = 5, heads: int = 3) -> list[Item]:
    """Exact matches first, then runs of deletes with runs of inserts at most ``gap`` items away, nearest first.

    Two single sentences are compared; then one against the first of the other run joined, up to ``heads``; then the
    runs as wholes, the longer also cut to the shorter's length.
    """
    s = Sentences(a, b)
    items = exact_items(s)
    k = 0
    while k < len(items):
        if items[k].kind != "delete":
            k += 1
            continue
        low = k
        while k < len(items) and items[k].kind == "delete":
            k += 1
        near = sorted((min(abs(q - low), abs(q - k + 1)), q) for q, x in enumerate(items) if x.kind == "insert" and min(abs(q - low), abs(q - k + 1)) <= gap)
        for _, q in near:
            high = q + 1
            while high < len(items) and items[high].kind == "insert":
                high += 1
            dels, adds = items[low:k], items[q:high]
            trial = None
            for m in range(1, heads + 1):
                for x, y in ((1, m), (m, 1)):
                    if x <= len(dels) and y <= len(adds):
                        t = Item("match", [i for d in dels[:x] for i in d.a], [j for c in adds[:y] for j in c.b])
                        t.similarity = s.of(t)
                        if t.similarity >= threshold and (trial is None or t.similarity > trial.similarity):
                            trial = t
                if trial:
                    break
            if trial is None and len(dels) + len(adds) > 2:
                t = Item("match", [i for d in dels for i in d.a], [j for c in adds for j in c.b])
                x, y = "".join(s.a[i] for i in t.a), "".join(s.b[j] for j in t.b)
                n = min(len(x), len(y))
                t.similarity = max(s.alike(x, y), s.alike(x[:n], y[:n]))
                trial = t if t.similarity >= threshold else None
            if trial:
                used = {id(z) for z in dels if z.a[0] in trial.a} | {id(z) for z in adds if z.b[0] in trial.b}
                first = next(p for p, z in enumerate(items) if id(z) in used and z.kind == "delete")
                items[first] = trial
                items = [z for z in items if id(z) not in used]
                k = low
                break
    return items


def exact_items(s: Sentences) -> list[Item]:
    """The exact alignment of one pair, in the order of ``exact``."""
    free: dict[str, list[int]] = {}
    for j in range(len(s.b) - 1, -1, -1):
        free.setdefault(s.b[j], []).append(j)
    items = [Item("match", [i], [free[x].pop()], 1.0) if free.get(x) else Item("delete", [i]) for i, x in enumerate(s.a)]
    at = {x.b[0]: x for x in items if x.b}
    behind: dict[int, list[Item]] = {}
    head: list[Item] = []
    latest: Item | None = None
    for j in range(len(s.b)):
        if j in at:
            latest = at[j]
        else:
            (head if latest is None else behind.setdefault(id(latest), [])).append(Item("insert", b=[j]))
    first = at[min(at)] if at else None
    out: list[Item] = []
    for x in items:
        out += [*(head if x is first else ()), x, *behind.get(id(x), ())]
    return out if first is not None else out + head


def align(sentences: DataFrame, method: str = "anchors", pair: str = "pair_id", stages: bool = False, **settings) -> DataFrame:
    """Aligns every pair of (pair_id, side, idx, text), side ``a`` or ``b``, in its own group.

    ``pair_id, stage, seq, type, a_indices, b_indices, similarity``; indices are those given. Pairs are the unit of
    work, since the scan goes through one pair in order; null and blank sentences are left out.
    """
    kind = sentences.schema[pair].dataType.simpleString()
    function: Callable = by_anchors if method == "anchors" else by_similarity

    def one(batch: pa.Table) -> pa.Table:
        key = batch.column(0)[0].as_py()
        sides: dict[str, list[tuple[int, str]]] = {"a": [], "b": []}
        for side, idx, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            if text and text.strip() and side in sides:
                sides[side].append((idx, text))
        a, b = sorted(sides["a"]), sorted(sides["b"])
        got = function([x for _, x in a], [x for _, x in b], **settings)
        named = got if method == "anchors" else [("similarity", got)]
        rows = [(key, name, seq, x.kind, [a[i][0] for i in x.a], [b[j][0] for j in x.b], x.similarity) for name, items in (named if stages else named[-1:]) for seq, x in enumerate(items)]
        types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64()]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["pair_id", "stage", "seq", "type", "a_indices", "b_indices", "similarity"])

    cols = sentences.select(pair, "side", F.col("idx").cast("int").alias("idx"), "text")
    return cols.groupBy(pair).applyInArrow(one, ALIGNMENT.format(key=kind)).withColumnRenamed("pair_id", pair)
