"""Packing of tokenized documents into fixed-length sequences by bulk-synchronous best fit.

Documents are tokenized, cut where they are longer than a sequence, and sorted by range on their
length, longest first, so that each piece has a rank.  Pieces of one length differ by rank only, and
so do sequences with one gap; a superstep therefore moves whole classes.  For each length, longest
first, the sweep finds the successor of the length among the gaps (the smallest gap that is large
enough), gives its sequences to the pieces by rank, as many to a sequence as the gap holds, puts what
is left of the gap back and repeats; without a successor it opens sequences.  That is best fit in
descending order, piece for piece.

A class of gaps is a list of runs of consecutive sequence numbers.  A length splits two runs at most
and a gap that is used is more than halved, so all supersteps together make at most
3 * capacity * (log2(capacity) + 1) moves, however many documents there are.  Only the counts by length and the moves
meet in one place; pieces are sorted, ranked and placed in parallel.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import byte_of_sign, text_groups
from linkloom.llm.token_counts import read_model
from linkloom.operators.ordering import with_global_index
from linkloom.runtime import materialize

CAPACITY = 1024
END_ID = 2
# Fixed value: how byte-level tokenizers cut a text before they merge.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters below it have the same kind in every version of Unicode since the first.
LATIN_END = "\u0250"
#: Words a task remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 400_000
_LOOSE = re.compile(r" (?:\s|$)")


def merger(model: bytes):
    """A faster encoder for Latin words with the vocabulary of a tokenizer's file, or None.

    It merges by the id of the merged token, so the file's merges must stand in the order of the ids
    and its words must be cut in the plain byte-level way.
    """
    import tiktoken

    spec = json.loads(model)
    cut, core = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in core.get("merges", [])]
    ids = [core["vocab"].get(a + b, -1) for a, b in pairs]
    if not plain or core.get("type") != "BPE" or any(x >= y for x, y in zip(ids, ids[1:])):
        return None
    signs, added = byte_of_sign(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(signs.__getitem__, t)): i for t, i in core["vocab"].items() if t not in added}
    return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Token ids under a byte-level tokenizer, given as the bytes of its file.

    Such a tokenizer cuts before each blank that a word follows, and what stands before the cut is
    encoded as if the text ended there.  Words are therefore encoded once and remembered, Latin words
    by ``merger`` and others by the library; texts with other white space beside a blank, or with a
    string of an added token, go to the library whole.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(model)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merger = merger(model)
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], words: set[str], before: str) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        new = list(words.difference(known))
        if self.merger:
            merge = self.merger.encode_ordinary
            latin = [w for w in new if w.isascii() or max(w) < LATIN_END]
            known.update(zip(latin, [array("I", merge(before + w)).tobytes() for w in latin]))
            new = [w for w in new if not (w.isascii() or max(w) < LATIN_END)]
        known.update(zip(new, self.encode([before + w for w in new])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone, as little-endian 32-bit numbers."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        loose = [bool(_LOOSE.search(t)) or any(a in t for a in self.added) for t in texts]
        whole = iter(self.encode([t for t, bad in zip(texts, loose) if bad]))
        cut = [t.partition(" ") for t, bad in zip(texts, loose) if not bad]
        rest = [after.split(" ") if blank else [] for _, blank, after in cut]
        self._learn(self.firsts, {first for first, _, _ in cut}, "")
        self._learn(self.words, set().union(*rest), " ")
        word = self.words.__getitem__
        known = iter([self.firsts[c[0]] + b"".join(map(word, r)) for c, r in zip(cut, rest)])
        return [next(whole if bad else known) for bad in loose]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``, with ``with_ids`` also ``ids``.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone.  One longer
    than ``capacity`` is cut into pieces of ``capacity``, of which the first takes the remainder.
    Rows that share an id, and null ids, keep their own pieces; an empty table has none; other columns
    are not read.  The tokenizer's file is read on the driver and travels with the job (two megabytes).
    """
    model = read_model(tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for group in text_groups(texts):
                rows, place, start, data = [], [], [], []
                for i, ids in zip(group, encoder.ids([texts[i] for i in group])):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    bounds = [0, *range(first, n + 1, capacity)]
                    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(i)
                        place.append(k)
                        start.append(lo)
                        data.append(ids[4 * lo : 4 * hi])
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(place, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(d) // 4 for d in data], pa.int64()),
                    pa.array(list(map(zlib.crc32, data)), pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(d, "<i4") for d in data], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def best_fit(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Moves that place ``counts[length]`` pieces: rows ``(rank, sequence, per_sequence, offset, length)``.

    A move holds from its rank up to the next move's.  Ranks count pieces from the longest; the j-th piece of a move goes to sequence
    ``sequence + j // per_sequence``, at ``offset + j % per_sequence * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    order: list[int] = []  # the gaps there are, ascending
    moves, rank, opened = [], 0, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    def fill(gap: int, first: int, n: int, length: int, left: int) -> int:
        """Give up to ``n`` sequences from ``first`` on to the pieces; how many pieces are left."""
        nonlocal rank
        each = gap // length
        full = min(n, left // each)
        if full:
            moves.append((rank, first, each, capacity - gap, length))
            put(gap - each * length, first, full)
            rank, left = rank + full * each, left - full * each
        rest = min(left, each) if full < n else 0
        if rest:
            moves.append((rank, first + full, rest, capacity - gap, length))
            put(gap - rest * length, first + full, 1)
            rank, left = rank + rest, left - rest
        put(gap, first + full + (rest > 0), n - full - (rest > 0))
        return left

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-left // (capacity // length))
                opened += n
                left = fill(capacity, opened - n, n, length, left)
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            left = fill(gap, first, n, length, left)
    return np.array(moves, np.int64).reshape(-1, 5)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts``, any table with ``length`` from 1 to ``capacity``, with ``sequence_id`` and ``offset`` of each row.

    Other columns stay; names that the operator uses itself may clash with none of them but those two.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in parts.columns])
    staged = materialize(parts.select(row.alias("row"), F.col("length").cast("long").alias("length")))
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not x or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths from 1 to {capacity} are expected")
    moves = best_fit(counts, capacity)
    keys = [F.col("row").getField(c) for c in ("doc_id", "piece") if c in parts.columns]
    ranked = with_global_index(
        staged.withColumn("tie", F.monotonically_increasing_id()), [F.col("length").desc(), *keys, F.col("tie")], "rank"
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(1).to_numpy()
            move = moves[np.searchsorted(moves[:, 0], rank, side="right") - 1]
            turn, nth = np.divmod(rank - move[:, 0], move[:, 2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(move[:, 1] + turn), pa.array(move[:, 3] + nth * move[:, 4])],
                ["row", "sequence_id", "offset"],
            )

    schema = f"row {staged.schema['row'].dataType.simpleString()}, sequence_id long, offset long"
    return ranked.select("row", "rank").mapInArrow(assign, schema).select("row.*", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, **columns) -> DataFrame:
    """Every piece of every document with its place: the columns of ``pieces``, ``sequence_id`` and ``offset``."""
    return place(pieces(docs, tokenizer_path, capacity, end_id, **columns), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences ``(sequence_id, ids, lengths)`` of pieces with their ids; one holds ``capacity`` ids at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return placed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths")
    )
