"""Problem 9: repetition inside a single document.

A linear-chain conditional random field labels the units of a document (its lines, cut at sentence ends and
every few letters) as content or boilerplate, here text the document has said before. Viterbi decoding
gives the labels, and the share of letters in boilerplate units decides which documents are kept; those that are not
are measured exactly. The field is fitted on the units of a bounded sample of documents, and of the same documents with
stretches of their own lines said again, labelled by the definition: most of the unit lies in repeated runs.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, sample, spread, table
from .ngram import codes, letters, repeated

RUN = 30  # letters and digits of a repeated run
SHARE = 0.3  # share from which a document counts as repetitive
GRAM = 20  # letters of the shorter runs that the features count
UNIT_LETTERS = 8  # letters of a unit at most
#: Labelled share from which a document is measured. Of a run of RUN letters at least ``RUN - 2 * (UNIT_LETTERS - 1)`` lie in
#: units that it fills, and `fit` sees to it that such units are boilerplate whatever is around them: no document is missed.
LEAST = SHARE * (RUN - 2 * (UNIT_LETTERS - 1)) / RUN
SAMPLE_DOCS = 300  # documents that the field is fitted on
SEGMENT, EPOCHS, SEED = 24, 120, 7

UNIT = re.compile(r"[^\r\n。！？!?]*(?:[。！？!?]+[”’」』）)\]»\"']*|[\r\n]+|$)|[^\r\n]+")
UNITS = "doc_id long, units int, boilerplate_units int, letters long, boilerplate_share double, repeated_share double"


@dataclass
class Units:
    """The units of some texts: the text of each, its letters, and the share of them seen before; letters of all texts in ``chars``."""

    owner: np.ndarray
    size: np.ndarray
    seen: np.ndarray
    chars: np.ndarray
    starts: np.ndarray  # of the texts in chars


def units_of(texts: list[str]) -> Units:
    parts, owner = [], []
    for k, text in enumerate(texts):
        units = [x for m in UNIT.findall(text) if (x := letters(m))]
        parts += units
        owner += [k] * len(units)
    whole = np.array([len(x) for x in parts], np.int64)
    pieces = -(-whole // UNIT_LETTERS)  # a long unit is cut into even parts
    owner = np.repeat(np.array(owner, np.int64), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.repeat(whole // np.maximum(pieces, 1), pieces) + (nth < np.repeat(whole % np.maximum(pieces, 1), pieces))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64), out=starts[1:])
    chars, _ = codes(parts)
    seen = shares_of(repeated(chars, starts, GRAM), size)
    return Units(owner, size, seen, chars, starts)


def shares_of(marked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of the marked letters in units that follow each other."""
    if not len(size):
        return np.empty(0)
    return np.add.reduceat(marked.astype(np.int64), np.cumsum(size) - size) / size


def features(units: Units) -> np.ndarray:
    """Of units: bias, share of letters seen before, whether it is above a half, and all, that of the neighbours, and shortness."""
    seen, owner = units.seen, units.owner
    same = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
    before, after = np.zeros_like(seen), np.zeros_like(seen)
    if len(seen):
        before[1:] = np.where(same, seen[:-1], 0)
        after[:-1] = np.where(same, seen[1:], 0)
    return np.stack([np.ones_like(seen), seen, seen > 0.5, seen == 1, before, after, units.size < 5], 1).astype(float)


def forward_backward(score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the labels of chains of one length (chains x units x labels) and sums of those of the transitions."""
    n = score.shape[1]
    f, b = np.empty_like(score), np.zeros_like(score)
    f[:, 0] = score[:, 0]
    for t in range(1, n):
        f[:, t] = score[:, t] + np.logaddexp(f[:, t - 1, :1] + trans[0], f[:, t - 1, 1:] + trans[1])
    for t in range(n - 2, -1, -1):
        on = score[:, t + 1] + b[:, t + 1]
        b[:, t] = np.logaddexp(trans[:, 0] + on[:, :1], trans[:, 1] + on[:, 1:])
    z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None, None]
    pair = np.exp(f[:, :-1, :, None] + trans + (score[:, 1:] + b[:, 1:])[:, :, None, :] - z[..., None])
    return np.exp(f + b - z), pair.sum((0, 1))


def said_again(text: str, rng: random.Random) -> str:
    """The text with stretches of its own lines said again, whole or broken off."""
    lines = [x for x in UNIT.findall(text) if x.strip()]
    if not lines:
        return text
    out = list(lines)
    for _ in range(rng.randint(1, len(lines))):
        a = rng.randrange(len(lines))
        again = "".join(lines[a : a + rng.randint(1, 3)])
        out.insert(rng.randrange(len(out)) + 1, again[: rng.randint(len(again) // 3, len(again))])
    return "".join(out)


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions, by gradient ascent on the log likelihood of the labelled units.

    Without a text, or with none long enough to repeat itself, all weights are 0 and every unit is content.
    """
    rng = random.Random(SEED)
    texts = [*texts, *(said_again(t, rng) for t in texts)]
    units = units_of(texts)
    x = features(units)
    y = (shares_of(repeated(units.chars, units.starts, RUN), units.size) > 0.5).astype(int)
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    if not y.any():
        return w, trans
    chains: dict[int, list[np.ndarray]] = {}
    bounds = np.concatenate([[0], np.cumsum(np.bincount(units.owner, minlength=len(texts)))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for k in range(a, b, SEGMENT):
            part = np.arange(k, min(b, k + SEGMENT))
            chains.setdefault(len(part), []).append(part)
    batches = [(x[at], np.eye(2)[y[at]]) for at in map(np.array, chains.values())]
    step = 1.0
    for _ in range(EPOCHS):
        gw, gt = np.zeros_like(w), np.zeros_like(trans)
        for bx, gold in batches:
            post, pair = forward_backward(bx @ w, trans)
            gw += np.einsum("ntf,ntl->fl", bx, gold - post)
            gt += np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - pair
        w += step * (gw / len(y) * 10 - 0.001 * w)
        trans += step * (gt / len(y) * 10 - 0.001 * trans)
    # a unit that was said before altogether must win against any neighbours
    lean = w[:, 1] - w[:, 0]
    margin = lean[:4].sum() + np.minimum(0, lean[4:]).sum() - 2 * float(trans.max() - trans.min())
    w[3, 1] += max(0.0, 0.01 - margin)
    return w, trans


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels; ties go to content."""
    (a, b), (caa, cab), (cba, cbb) = score[0].tolist(), trans[0].tolist(), trans[1].tolist()
    back = []
    for sa, sb in score[1:].tolist():
        ka, kb = b + cba > a + caa, b + cbb > a + cab
        back.append((ka, kb))
        a, b = (b + cba if ka else a + caa) + sa, (b + cbb if kb else a + cab) + sb
    out = [int(b > a)]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return np.array(out[::-1], bool)


def label_batch(texts: list[str], w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: units, boilerplate units, letters, letters in boilerplate units."""
    units = units_of(texts)
    owner, size = units.owner, units.size
    n_units, n_letters = np.bincount(owner, minlength=len(texts)), np.diff(units.starts)
    label = np.zeros(len(owner), bool)
    if len(owner):
        score = features(units) @ w
        bounds = np.concatenate([[0], np.cumsum(n_units)])
        # a document none of whose units scores better as boilerplate, alone or between two, stays all content
        lean = score[:, 1] - score[:, 0] + 2 * max(0.0, float(trans.max() - trans.min()))
        hopeful = np.bincount(owner, lean > 0, len(texts)) > 0
        for k in np.nonzero(hopeful)[0]:
            a, b = bounds[k], bounds[k + 1]
            label[a:b] = viterbi(score[a:b], trans)
    return n_units, np.bincount(owner, label, len(texts)).astype(np.int64), n_letters, np.bincount(owner, size * label, len(texts)).astype(np.int64)


def exact_shares(texts: list[str]) -> np.ndarray:
    """Share of the letters and digits that lie in runs of RUN or more that occurred earlier."""
    chars, starts = codes([letters(t) for t in texts])
    size = np.diff(starts)
    marked = np.concatenate([[0], np.cumsum(repeated(chars, starts, RUN))])
    return np.divide(marked[starts[1:]] - marked[starts[:-1]], size, out=np.zeros(len(texts)), where=size > 0)


def labelled(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """One row per document whose boilerplate share is at least ``least``, with both shares; ``field`` comes from `fit`.

    ``docs``: doc_id, text. Null and letterless texts have no units and shares of 0; repeated rows count each for
    itself. ``repeated_share`` is exact; it is measured on the selected documents only.
    """
    w, trans = field

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        units, bad, size, bad_size = label_batch(texts, w, trans)
        share = np.divide(bad_size, size, out=np.zeros(len(texts)), where=size > 0)
        keep = np.nonzero(share >= least)[0]
        exact = exact_shares([texts[k] for k in keep])
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(keep)), *(pa.array(x) for x in (units[keep].astype(np.int32), bad[keep].astype(np.int32), size[keep], share[keep], exact))],
            ["doc_id", "units", "boilerplate_units", "letters", "boilerplate_share", "repeated_share"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, UNITS)


def field_of(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The field, fitted on about SAMPLE_DOCS documents."""
    return fit(sample(docs, "doc_id", "text", SAMPLE_DOCS))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shares of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return labelled(spread(docs), field_of(docs), 0.0)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not retained: labelled as boilerplate to LEAST or more, and SHARE or more by the exact check that follows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return labelled(spread(docs), field_of(docs), LEAST).where(F.col("repeated_share") >= SHARE).select("doc_id")
