"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints of two bits' difference or less are linked.  Two changed bits touch at most two of the
eight bytes, so a linked pair agrees on six bytes and meets in one of the 28 blocks "all but these
two bytes".  Members of a block differ in 16 bits only, so a block has at most 65 536 different
fingerprints, however many documents there are.  Inside a block the Hamming distances of its
members to many reference fingerprints are tabulated; by the triangle inequality a pair whose
distances to any reference differ by more than two cannot be linked, and only the survivors are
compared.  A block hands on a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import connected_components, shuffle_width
from linkloom.runtime import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
PIVOTS = 24
#: Masks that clear two of the eight bytes, as signed 64-bit values.
BLOCK_MASKS = [
    int(np.array(~np.uint64((0xFF << (8 * a)) | (0xFF << (8 * b)))).view(np.int64)) for a, b in combinations(range(8), 2)
]
_CHUNK = 1 << 15


def references(count: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """The reference fingerprints: seeded, the same in every task."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, dtype=np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority vote of the bits of all shingle hashes of the whole text; 0 without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, _CHUNK):
        codes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK])], np.uint64)
        votes += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _majority(votes, n)


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(codes: np.ndarray) -> int:
    """The fingerprint of given shingle hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(codes), _CHUNK):
        votes += np.unpackbits(codes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _majority(votes, len(codes))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), codes], ["rid", "doc_id", "fp"])


def linked_within(members: np.ndarray, pivots: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``members`` (different fingerprints) at ``bits`` or fewer differing bits.

    The members are sorted by their distance to the first reference; a pair is looked at while that
    coordinate allows it, then discarded by the largest difference over the other references.
    """
    table = np.bitwise_count(members[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, ranked = np.ascontiguousarray(table[order].T), members[order]
    left, right = [], []
    for step in range(1, len(members)):
        at = np.flatnonzero(table[0, step:] - table[0, :-step] <= bits)
        if not len(at):
            break
        for row in table[1:]:
            at = at[np.abs(row[at + step] - row[at]) <= bits]
        at = at[np.bitwise_count(ranked[at + step] ^ ranked[at]) <= bits]
        if len(at):
            left.append(order[at])
            right.append(order[at + step])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(members: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each member to the head of its part of the block, if it has another."""
    a, b = linked_within(members, pivots)
    head = np.arange(len(members))
    while True:
        before = head.copy()
        low = np.minimum(head[a], head[b])
        np.minimum.at(head, a, low)
        np.minimum.at(head, b, low)
        head = head[head]
        if np.array_equal(before, head):
            break
    moved = np.flatnonzero(head != np.arange(len(members)))
    return members[moved], members[head[moved]]


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block may span batches, and the open one is carried on."""
    pivots = references()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def closed(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
        bounds = np.concatenate([[0], edge, [len(fp)]])
        sizes = np.diff(bounds)
        u, v = [], []
        for k in np.flatnonzero(sizes > 1):
            a, b = _forest(fp[bounds[k] : bounds[k + 1]].view(np.uint64), pivots)
            u.append(a)
            v.append(b)
        if u and sum(map(len, u)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"]
            )

    for batch in batches:
        part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(part[0]):
            continue
        held.append(part)
        kind, key = part[0], part[1]
        if held[0][0][0] == kind[-1] and held[0][1][0] == key[-1]:
            continue  # still one open block
        kind, key, fp = (np.concatenate(x) for x in zip(*held))
        last = len(fp) - int(np.argmax((kind[::-1] != kind[-1]) | (key[::-1] != key[-1])))
        yield from closed(kind[:last], key[:last], fp[:last])
        held = [(kind[last:], key[last:], fp[last:])]
    if held:
        yield from closed(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all different fingerprints ``fp`` at two bits or fewer."""
    blocks = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(BLOCK_MASKS)])
        ).alias("b"),
    ).select("b.kind", "b.key", "fp")
    return (
        blocks.repartition(shuffle_width(fps), "kind", "key")
        .sortWithinPartitions("kind", "key")
        .mapInArrow(_block_links, "u long, v long")
    )


def components(fps: DataFrame) -> DataFrame:
    """``fps(rid, doc_id, fp)``, a written table, with the smallest ``doc_id`` its links reach.

    Equal fingerprints are collapsed before any link is sought, so a group of copies is one node.
    """
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tree = connected_components(fingerprint_links(nodes))
    owner = nodes.join(tree, nodes["fp"] == tree["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first"
    )
    firsts = owner.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(owner.select("fp", "component").join(firsts, "component"), "fp")


def fingerprints(staged: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(rid, doc_id, fp)`` of ``staged``, which has a row number ``rid``; written once."""
    return materialize(
        staged.select("rid", F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id")).mapInArrow(
            _fingerprints, "rid long, doc_id long, fp long"
        )
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that links reach from the row, its own included.  Null and
    empty texts have fingerprint zero and are linked with each other.  A null id keeps its row and
    names a component only if there is no other id in it (then null).  Rows that share an id are
    fingerprinted each for itself.  An empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return components(fingerprints(slim.withColumn("rid", F.lit(0).cast("long")))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with the input's columns, of which one stays in each component.

    The row with the smallest id stays, null ids rank last; of several rows with that id one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    staged = materialize(docs.select(row.alias("row")).withColumn("rid", F.monotonically_increasing_id()))
    fps = fingerprints(
        staged.select("rid", F.col("row").getField(text_col).alias("text"), F.col("row").getField(id_col).alias("doc_id"))
    )
    marked = components(fps)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    stays = marked.groupBy("component").agg(best.alias("best")).select(F.col("best.rid").alias("rid"))
    return staged.join(stays, "rid").select("row.*")
