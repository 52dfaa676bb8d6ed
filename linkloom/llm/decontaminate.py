"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, overlap check.

The index holds the test items in blocks; each term has, for every block it occurs in, its largest
BM25 weight there.  Every passage of every document is a query: windows of twice the longest item,
half overlapping, so that each item lies whole in one.  A passage and a block are bounded by the
sum of the block weights of the passage's terms.  Common terms, which are in a quarter of the items
or more, are never looked up for that; the bound adds all that they could give.  Where the bound
stays below the lowest threshold in the block, the block is skipped; in the others all items are
scored, and every item at or above its threshold is retrieved.  The bounds of all passages of a
batch are taken in one pass over its words.

A retrieved item counts as leaked when the document holds its question and its answer, the two
halves of its words: 0.8 of each half's five-word shingles (a half of fewer words is one shingle).
The halves may lie apart.  One of them has half of the item's score or more and lies in one passage,
which retrieves the item; where a passage holds a half, the whole document decides.

A benchmark of more than ``INDEX_ITEMS`` items is searched in slices.  Frequencies of words, number
and lengths of the items are those of all items, whatever the slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

SHINGLE_WORDS = 5
OVERLAP = 0.8
#: Share of an item's own BM25 score that a passage must reach; the better half alone has as much.
SCORE_SHARE = 0.5
K1, B = 1.2, 0.75
#: Terms in at least this share of the items are bounded, not looked up.
COMMON_SHARE = 0.25
BLOCK_ITEMS, MAX_BLOCKS = 4, 256
#: Items in one index; a larger benchmark is cut into as many indexes as needed, each one pass.
INDEX_ITEMS = 20_000
BATCH_CHARS = 1 << 21
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], size: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@dataclass
class Index:
    """Items in the order of their thresholds, which keeps the items of a block alike."""

    ids: list[int]
    terms: dict[str, int]
    begin: np.ndarray  # first block entry of each term; common terms have none
    block: np.ndarray
    block_top: np.ndarray  # largest weight of the term in the block
    spare: np.ndarray  # per block, the most that the common terms give together
    lowest: np.ndarray  # per block, the lowest threshold
    weights: list[dict[str, float]]  # per item
    need: np.ndarray
    halves: list[list[set]]
    per_block: int
    longest: int


@dataclass(frozen=True)
class Statistics:
    """Of all items that have words: how many, their mean and longest length, and the items of each word."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


def statistics(items: list[tuple[int, str | None]]) -> Statistics:
    listed = [w for _, t in items if (w := words_of(t))]
    df: dict[str, int] = {}
    for words in listed:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    total = sum(map(len, listed))
    return Statistics(len(listed), total / max(1, len(listed)), max(map(len, listed), default=1), df)


def build_index(items: list[tuple[int, str | None]], whole: Statistics | None = None) -> Index:
    """Index of ``(id, text)``; items without words cannot leak and are left out.

    ``whole`` has the statistics of all items if these are a slice; its words need only be theirs.
    """
    kept = [(i, w) for i, t in items if (w := words_of(t))]
    whole = whole or statistics(items)
    mean, df = whole.mean, whole.df

    def weigh(words: list[str]) -> dict[str, float]:
        norm = K1 * (1 - B + B * len(words) / mean)
        tf: dict[str, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        return {
            w: float(np.log1p((whole.items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm)) for w, n in tf.items()
        }

    rows = sorted(((SCORE_SHARE * sum(x.values()), i, w, x) for i, w in kept for x in [weigh(w)]), key=lambda r: r[:2])
    per_block = max(BLOCK_ITEMS, -(-len(rows) // MAX_BLOCKS))
    blocks = -(-len(rows) // per_block)
    tops: dict[str, dict[int, float]] = {w: {} for w in sorted({w for _, words in kept for w in words})}
    for k, row in enumerate(rows):
        for w, x in row[3].items():
            own = tops[w]
            own[k // per_block] = max(own.get(k // per_block, 0.0), x)
    begin, block, top, spare = [0], [], [], np.zeros(blocks)
    for w, own in tops.items():
        if df[w] >= COMMON_SHARE * whole.items:
            for b, x in own.items():
                spare[b] += x
        else:
            block += own.keys()
            top += own.values()
        begin.append(len(block))
    need = np.array([r[0] for r in rows])
    halves = [[shingles(h) for h in (r[2][: len(r[2]) // 2], r[2][len(r[2]) // 2 :]) if h] for r in rows]
    return Index(
        [r[1] for r in rows], {w: j for j, w in enumerate(tops)}, np.array(begin), np.array(block, np.int64), np.array(top, float),
        spare, need[::per_block], [r[3] for r in rows], need, halves, per_block, whole.longest,
    )


def overlaps(halves: list[set], words: list[str], held: dict[int, set] | None = None) -> float:
    """The smaller share of the two halves' shingles that ``words`` hold; ``held`` keeps those of the words."""
    least, held = 1.0, {} if held is None else held
    for half in halves:
        size = len(next(iter(half)))
        if size not in held:
            held[size] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        least = min(least, len(half & held[size]) / len(half))
    return least


def find_leaks(index: Index, texts: list[str | None]) -> list[dict[int, tuple[float, float]]]:
    """For each text its leaked items: id to (best share of the own score, best overlap)."""
    found: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
    if not index.ids:
        return found
    words = [words_of(t) for t in texts]
    step = index.longest
    sizes = np.array([len(w) for w in words], np.int64)
    parts = np.maximum(1, -(-sizes // step))
    first = np.cumsum(parts) - parts
    get = index.terms.get
    ids = np.array([get(w, -1) for ws in words for w in ws], np.int64)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    part = np.repeat(first, sizes) + at // step
    known = ids >= 0
    ids, part = ids[known], part[known]
    count = index.begin[ids + 1] - index.begin[ids]
    entry = np.repeat(index.begin[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    blocks = len(index.spare)
    bound = np.bincount(
        np.repeat(part, count) * blocks + index.block[entry], index.block_top[entry], int(parts.sum()) * blocks
    ).reshape(-1, blocks)
    owner = np.repeat(np.arange(len(texts)), parts)
    both = bound.copy()
    both[:-1] += bound[1:] * (owner[1:] == owner[:-1])[:, None]
    last, held, at_passage, near = -1, {}, -1, {}
    for p, b in np.argwhere(both + index.spare >= index.lowest - 1e-9).tolist():
        d = int(owner[p])
        if d != last:
            last, held, refused = d, {}, set()
        lo = (p - int(first[d])) * step
        passage = words[d][lo : lo + 2 * step]
        if p != at_passage:
            at_passage, near = p, {}
        distinct = set(passage)
        for k in range(b * index.per_block, min((b + 1) * index.per_block, len(index.ids))):
            if k in refused:
                continue
            weights = index.weights[k]
            score = sum(x for w, x in weights.items() if w in distinct)
            if score < index.need[k] - 1e-9:
                continue
            if all(overlaps([half], passage, near) < OVERLAP for half in index.halves[k]):
                continue  # no half lies here; the whole document is only looked at where one does
            share = overlaps(index.halves[k], words[d], held)
            if share < OVERLAP:
                refused.add(k)
            else:
                item = index.ids[k]
                old = found[d].get(item, (0.0, 0.0))
                found[d][item] = (max(old[0], SCORE_SHARE * score / index.need[k]), max(old[1], share))
    return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each item, with its slot; the empty word stands for the item, with its length."""
    for batch in batches:
        rows = []
        for slot, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words := words_of(text):
                rows += [(slot, "", len(words)), *((slot, w, 0) for w in set(words))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.string(), pa.int64()))], ["slot", "word", "size"])


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The test items on the driver, at most about ``INDEX_ITEMS`` and their words at a time."""
    slim = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i IS NOT NULL")
    slots = -(-slim.count() // INDEX_ITEMS)
    slotted = slim.withColumn("slot", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, slots))).cast("int"))
    if slots == 1:
        yield build_index([(r.i, r.t) for r in slotted.collect()])
        return
    if not slots:
        return
    words = materialize(slotted.select("slot", "t").mapInArrow(_words, "slot int, word string, size long"))
    one = words.where("word = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest")).first()
    df = materialize(words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    for k in range(slots):
        own = df.join(words.where(F.col("slot") == k).select("word").distinct(), "word")
        whole = Statistics(one.n, one.mean or 0.0, one.longest or 1, {r.word: r.n for r in own.collect()})
        yield build_index([(r.i, r.t) for r in slotted.where(F.col("slot") == k).collect()], whole)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and leaked item: ``doc_id``, ``item_id``, ``score``, ``overlap``.

    Null or empty texts and items leak nothing; items with a null id are no items.  Rows that share
    a document id are judged each for itself and give their rows; a null document id keeps its rows.
    An empty table on either side gives an empty result; other input columns are not read.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for index in _indexes(items, item_id_col, item_text_col):
        part = slim.mapInArrow(_search(index), "doc_id long, item_id long, score double, overlap double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = slim.limit(0).selectExpr("doc_id", "doc_id as item_id", "0D as score", "0D as overlap")
    return out


def _search(index: Index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                for doc, found in zip(ids[lo:hi], find_leaks(index, texts[lo:hi])):
                    rows += [(doc, item, score, share) for item, (score, share) in sorted(found.items())]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "overlap"])

    return search


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH_CHARS:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _screen(index: Index, text_at: int):
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            clean = [not f for lo, hi in _slices(texts) for f in find_leaks(index, texts[lo:hi])]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return screen


def drop_leaked(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows without a leaked item, with the input's columns; nulls and empties as in ``leaks``."""
    out = docs
    for index in _indexes(items, "item_id", "text"):
        out = out.mapInArrow(_screen(index, docs.columns.index(text_col)), docs.schema)
    return out
