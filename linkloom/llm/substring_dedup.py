"""Duplicate passages by relative Lempel-Ziv parsing against all earlier documents.

Reference index.  Each document is cut into reference blocks around anchors: in every window of 50
words the 8-word sequence with the smallest hash is the anchor, and the consecutive windows with
one anchor occurrence make one block.  The anchor of a window depends on its words alone, so equal
windows have equal anchors at the same offset, wherever they stand.  Every block of every document
is indexed, under its anchor and the hash of all its words; that is one row per some twenty words.

Parsing.  A document is factored against the blocks of documents with a smaller id.  Where all
blocks of an anchor are the same words, the whole block is one factor.  Where they differ, factor
boundaries fall inside the block, and each of its windows is looked up; one row per *different*
block is expanded for that, not one per copy.  Matching windows with the same source join into
factors of at least 50 words, which are the duplicate spans.

Words are identified by 64-bit hashes; a window by its anchor, offset and a hash with another base,
128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

WINDOW = 50
ANCHOR_WORDS = 8
BATCH_BYTES = 1 << 21
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)

_BLOCK = pa.struct([("start", pa.int32()), ("cnt", pa.int32()), ("off", pa.int32()), ("a", pa.int64()), ("c", pa.int64())])
_BLOCK_DDL = "start: int, cnt: int, off: int, a: bigint, c: bigint"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Hashes of any word range of a sequence of word hashes, in constant time each."""

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes) + 1
        with np.errstate(over="ignore"):
            powers, self.inverse = (_powers(b, n) for b in (base, pow(base, -1, 1 << 64)))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.inverse[start]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03)
            return x ^ (x >> np.uint64(29))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def reference_blocks(codes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, k: int = ANCHOR_WORDS):
    """Blocks of the documents whose words are ``codes[bounds[i]:bounds[i + 1]]``.

    Returns arrays: document, first word, number of windows, offset of the anchor, anchor, words.
    """
    n = len(codes)
    if n < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    first, second = Rolling(codes, _BASES[0]), Rolling(codes, _BASES[1])
    at = np.arange(n - k + 1)
    grams = first.range(at, at + k)
    ranked = (grams & ~_LOW) | at.astype(np.uint64)
    chosen = (_sliding_min(ranked, window - k + 1) & _LOW).astype(np.int64)
    starts = np.arange(n - window + 1)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + window <= bounds[owner + 1]
    starts, owner, chosen = starts[inside], owner[inside], chosen[inside]
    if not len(starts):
        return reference_blocks(codes[:0], bounds)
    cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(owner) != 0)) + 1
    head = np.concatenate([[0], cut])
    count = np.diff(np.concatenate([head, [len(starts)]]))
    s, anchor = starts[head], chosen[head]
    words = second.range(s, s + count - 1 + window)
    return owner[head], s - bounds[owner[head]], count, anchor - s, grams[anchor].view(np.int64), words.view(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH_BYTES:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in _slices(texts):
            words = [split_words(t) for t in texts[lo:hi]]
            sizes = np.array([len(w) for w in words], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = batch.column(0).slice(lo, hi - lo)
            codes = np.concatenate([word_codes(w) for w in words])
            doc, *fields = reference_blocks(codes, bounds)
            known = np.asarray(ids.is_valid())[doc] if len(doc) else np.empty(0, bool)
            doc, fields = doc[known], [f[known] for f in fields]
            offsets = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            blocks = pa.StructArray.from_arrays(
                [pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(fields, _BLOCK)], fields=list(_BLOCK)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    batch.column(1).slice(lo, hi - lo),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]),
                    pa.ListArray.from_arrays(pa.array(offsets), blocks),
                ],
                ["doc_id", "tkey", "n_words", "sha", "blocks"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the listed blocks of each document: its block, place and word hash."""
    for batch in batches:
        rows = batch.to_pydict()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for doc_id, text, blocks in zip(rows["doc_id"], rows["text"], rows["blocks"]):
            rolling = Rolling(word_codes(split_words(text)), _BASES[1])
            start, cnt, off, a, kid = (np.array([b[f] for b in blocks], np.int64) for f in ("start", "cnt", "off", "a", "kid"))
            of = np.repeat(np.arange(len(blocks)), cnt)
            t = np.arange(len(of)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            s = start[of] + t
            with np.errstate(over="ignore"):  # the anchor's place in the window is part of its identity
                code = rolling.range(s, s + WINDOW) + (off[of] - t).astype(np.uint64) * np.uint64(_BASES[0])
            for held, x in zip(out, (kid[of], t.astype(np.int32), a[of], code.view(np.int64), np.full(len(of), doc_id))):
                held.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["kid", "t", "a", "code", "doc_id"])


def factors(n_words: int, doc_id: int, matches: list[dict]) -> list[tuple[int, int, int]]:
    """Greedy parse: factors ``(first word, words, source document)`` in text order.

    ``matches`` has the document's blocks: ``source`` is the first document with the same block, and
    ``windows`` of ``(t, source)`` are those windows that stand in an even earlier document.
    """
    source = np.full(max(0, n_words - WINDOW + 1), -1, np.int64)
    hit = np.zeros(len(source), bool)
    for m in matches:
        if m["source"] < doc_id:
            source[m["start"] : m["start"] + m["cnt"]] = m["source"]
            hit[m["start"] : m["start"] + m["cnt"]] = True
        for w in m["windows"] or ():
            source[m["start"] + w["t"]] = w["source"]
            hit[m["start"] + w["t"]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(source[at]) != 0)) + 1
    head = np.concatenate([[0], cut])
    tail = np.concatenate([cut, [len(at)]]) - 1
    return [(int(at[h]), int(at[t] - at[h]) + WINDOW, int(source[at[h]])) for h, t in zip(head, tail)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        removed, digests, parsed = [], [], []
        for doc_id, text, matches in zip(rows["doc_id"], rows["text"], rows["matches"]):
            words = split_words(text)
            spans = factors(len(words), doc_id, matches)
            gone = np.zeros(len(words) + 1, np.int64)
            for start, size, _ in spans:
                gone[start] += 1
                gone[start + size] -= 1
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
            parsed.append([{"start": s, "n_words": n, "source_id": d} for s, n, d in spans])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(parsed, pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source_id", pa.int64())]))),
            ],
            ["doc_id", "tkey", "n_removed", "kept_sha256", "factors"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``factors``.

    ``factors`` lists the duplicate spans as (first word, words, smallest source id), in words of
    the input.  A null text has no words.  A row with a null id is neither parsed nor a reference.
    Rows that share an id are no references for each other and each get their row.  Texts of fewer
    than 50 words have no window.  An empty table gives an empty result; other input columns are
    not read.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    base = materialize(
        slim.mapInArrow(
            _index,
            f"doc_id long, tkey long, n_words long, sha string, blocks array<struct<{_BLOCK_DDL}>>",
        )
    )
    spots = base.select("doc_id", "tkey", F.inline("blocks"))
    # Tables with one row per key are written before they are joined: the sides of such a join are
    # plain shuffles then, and Spark splits the partitions of a hot key.
    anchors = materialize(
        spots.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    )
    held = materialize(spots.join(anchors, "a"))
    block = ["a", "c", "off", "cnt"]
    kinds = materialize(
        held.groupBy(*block)
        .agg(F.min(F.struct("doc_id", "tkey", "start")).alias("first"), F.max("doc_id").alias("last"))
        .withColumn("kid", F.monotonically_increasing_id())
    )
    mixed = materialize(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a"))
    wanted = held.select("doc_id", "tkey").distinct()
    texts = materialize(slim.join(wanted, ["doc_id", "tkey"]))

    expand = (
        kinds.join(mixed, "a")
        .select("first.doc_id", "first.tkey", F.struct("first.start", "cnt", "off", "a", "kid").alias("b"))
        .groupBy("doc_id", "tkey")
        .agg(F.collect_list("b").alias("blocks"))
    )
    windows = materialize(
        texts.join(expand, ["doc_id", "tkey"])
        .select("doc_id", "text", "blocks")
        .mapInArrow(_window_rows, "kid long, t int, a long, code long, doc_id long")
    )
    sources = materialize(
        windows.groupBy("a", "code").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    )
    earlier = (
        windows.join(sources, ["a", "code"])
        .where("source < doc_id")
        .groupBy("kid")
        .agg(F.collect_list(F.struct("t", "source")).alias("windows"))
    )
    judged = (
        kinds.select(*block, "kid", "last", F.col("first.doc_id").alias("source"))
        .join(earlier, "kid", "left")
        .where("source < last OR windows IS NOT NULL")
        .select(*block, "source", "windows")
    )
    matches = (
        held.join(judged, block)
        .where("source < doc_id OR windows IS NOT NULL")
        .groupBy("doc_id", "tkey")
        .agg(F.collect_set(F.struct("start", "cnt", "source", "windows")).alias("matches"))
    )
    parsed = (
        texts.join(matches, ["doc_id", "tkey"])
        .select("doc_id", "tkey", "text", "matches")
        .mapInArrow(
            _parse,
            "doc_id long, tkey long, n_removed long, kept_sha256 string, "
            "factors array<struct<start: bigint, n_words: bigint, source_id: bigint>>",
        )
        .dropDuplicates(["doc_id", "tkey"])
    )
    return base.drop("blocks").join(parsed, ["doc_id", "tkey"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "factors",
    )
