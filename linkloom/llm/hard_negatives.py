"""Hard negatives by slot-decomposed selection.

Each positive of an anchor asks for the best negatives in a window of scores.  The windows of one
anchor overlap, but their upper limits cut the scores into disjoint slots, and what lies at or below
a limit is a suffix of the slots.  So combiners keep, per anchor and slot, the best k negatives of
their rows; merged once more, the slots from a positive's own downwards hold the best k at or below
its limit, and those above the window's lower end are its answer.

Anchors meet the rows in slices of a bounded number of vector components.  A slice is broadcast and
the rows are scanned where they lie, once for the positives and once for the slots; only the best of
each task are shuffled.  The number of scans grows with the anchors, the size of a slice does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.ordering import with_global_index
from linkloom.runtime import materialize

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (30, 90)
SLICE_ANCHORS, SLICE_VALUES = 1 << 13, 1 << 22
BLOCK_ANCHORS, BLOCK_ROWS = 1 << 10, 1 << 11
_PENDING = 1 << 18


class Best:
    """The best ``k`` of each group: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min)  # a score below it cannot enter the group any more
        self.kept = [np.zeros(0, np.int64)] * 4
        self.new: list[list[np.ndarray]] = []
        self.pending = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        good = score >= self.least[group]
        self.new.append([group[good], score[good].astype(np.int64), ids[good], rid[good]])
        self.pending += int(good.sum())
        if self.pending > _PENDING:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        group, score, ids, rid = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((rid, ids, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        place = np.arange(len(group)) - first
        stays = place < self.k
        self.kept = [x[stays] for x in (group, score[order], ids[order], rid[order])]
        full = place == self.k - 1
        self.least[group[full]] = score[order][full]
        self.new, self.pending = [], 0
        return self.kept


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = values[offsets[0] : offsets[-1]]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return a @ b.T
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    return np.array(exact, object).reshape(len(a), len(b)).clip(-(2**63) + 1, 2**63 - 1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, labels: np.ndarray, width: int):
    """Of each block of anchors and rows: first anchor, scores, whether labels agree, ids and row numbers."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            rid, ids, label = (part.column(i).to_numpy() for i in range(3))
            rows = _matrix(part.column(3), width)
            for a in range(0, len(anchors), BLOCK_ANCHORS):
                block = slice(a, a + BLOCK_ANCHORS)
                yield a, _scores(anchors[block], rows), labels[block, None] == label[None, :], ids, rid


def _positives(anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, k: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors), k)
        for a, score, same, ids, rid in _blocks(batches, anchors, labels, anchors.shape[1]):
            least = best.least[a : a + len(score), None]
            i, j = np.nonzero(same & (score >= least) & (own[a : a + len(score), None] != rid[None, :]))
            best.add(a + i, score[i, j], ids[j], rid[j])
        group, score, ids, rid = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, score, ids, rid)], ["a", "score", "id", "rid"])

    return select


def _slots(anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """``low``, ``high``: window of each anchor and positive, by descending upper limit."""
    n_slots = high.shape[1]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors) * n_slots, k)
        for a, score, same, ids, rid in _blocks(batches, anchors, labels, anchors.shape[1]):
            here = slice(a, a + len(score))
            i, j = np.nonzero(~same & (score >= low[here].min(axis=1)[:, None]) & (score <= high[here, :1]))
            found = score[i, j]
            slot = (found[:, None] <= high[a + i]).sum(axis=1) - 1
            best.add((a + i) * n_slots + slot, found, ids[j], rid[j])
        group, score, ids, _ = best.settle()
        a, slot = np.divmod(group, n_slots)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, slot, score, ids)], ["a", "slot", "score", "id"])

    return select


def _first(rows: DataFrame, keys: list[str], k: int, *ties: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _slice(base: DataFrame, anchors: pa.Table, width: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    vectors = _matrix(anchors.column("v").combine_chunks(), width)
    own, ids, labels = (anchors.column(c).to_numpy() for c in ("rid", "id", "label"))
    found = base.mapInArrow(_positives(vectors, labels, own, positives), "a long, score long, id long, rid long")
    top = _first(found, ["a"], positives, "id", "rid").toArrow()  # a few for each anchor of the slice
    a, place, score = (top.column(c).to_numpy() for c in ("a", "place", "score"))
    scores = [int(s) for s in score]
    lows, highs = [-(-window[0] * s // 100) for s in scores], [window[1] * s // 100 for s in scores]
    low = np.full((len(vectors), positives), np.iinfo(np.int64).max)
    high = np.full((len(vectors), positives), np.iinfo(np.int64).min)
    low[a, place - 1], high[a, place - 1] = lows, highs  # scores fall with the place, and so do the limits
    slots = _first(base.mapInArrow(_slots(vectors, labels, low, high, negatives), "a long, slot long, score long, id long"), ["a", "slot"], negatives, "id")
    ordered = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")))
    merged = slots.groupBy("a").agg(ordered.alias("slots"))
    asked = base.sparkSession.createDataFrame(
        pa.table({"a": a, "anchor_id": ids[a], "positive_id": top.column("id"), "positive_score": score, "place": place, "low": pa.array(lows, pa.int64())})
    )
    suffix = F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("place") - 1), 1, negatives)
    answer = F.filter(suffix, lambda s: -s["down"] >= F.col("low"))
    return (
        asked.join(merged, "a")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("rank", "n"))
        .select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
    )


def quantized(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """``(id, label, v)`` of the rows that can take part, each component being ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part.
    """
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    picked = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("v"))
    return picked.dropna()


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """Hard negatives of ``rows(id, label, v)``, the vectors being whole numbers.

    ``is_anchor`` is a condition on the columns of ``rows``.  An anchor's positives are the first of
    the other rows with its label, by score, then id; for each positive up to ``negatives`` rows of
    other labels whose score is within ``window`` hundredths of the positive's are returned, as
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows that share an id are rows of their own; equal ones share a place in any order.  Vectors of
    different lengths are compared as if the shorter ended in zeros.  Scores are exact; what a long
    cannot hold is clipped.  An anchor without positives, or a positive without a row in its window
    (always, if its score is negative), has no result; nor has an empty table.
    """
    base = materialize(rows.select("id", "label", "v").withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "label", "v"))
    width = base.agg(F.max(F.size("v"))).first()[0] or 0
    numbered = with_global_index(base.where(is_anchor), [F.col("id"), F.col("rid")], "number")
    step = max(1, min(SLICE_ANCHORS, SLICE_VALUES // max(1, width)))
    anchors = materialize(numbered.withColumn("slice", F.floor(F.col("number") / step).cast("int")), "slice")
    count = anchors.agg(F.max("slice")).first()[0]
    found = []
    for i in range(0 if count is None else count + 1):
        taken = anchors.where(F.col("slice") == i).select("rid", "id", "label", "v").toArrow()
        found.append(_slice(base, taken, width, positives, negatives, window))
    if not found:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [materialize(f) for f in found] if len(found) > 1 else found)
