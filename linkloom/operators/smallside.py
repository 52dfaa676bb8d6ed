"""Decomposition through the smaller side of a document-term matrix.

The side with fewer rows (documents or terms) is numbered 0 .. n - 1, the entries are packed by row
of either side, and the left factor lives on the driver as slices of a bounded number of values:

* ``gram``: n up to ``GRAM_SIDE``.  Spark computes the n x n matrix of inner products in pairs of
  row blocks, the driver its eigenvectors.  Exact, one pass.
* ``lanczos``: basis of n x width values within ``BASIS_VALUES``, restarted when a few components of
  many rows leave it no more width.  Block Lanczos: a pass multiplies a
  slice of columns by the matrix and its transpose where the packed rows lie (the slice is
  broadcast, rows of results come back, nothing is shuffled); the driver orthogonalises twice.

Past that, ``svd.truncated_svd`` keeps the basis in a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.ordering import with_global_index
from linkloom.runtime import materialize

GRAM_SIDE = 4096  # a matrix of 128 MB
BASIS_VALUES = 1 << 27  # 1 GB
SLICE_VALUES = 1 << 22  # of a broadcast slice, 32 MB
_COLUMNS = 128  # of a Lanczos block
_CHUNK = 1 << 14  # terms that a block product unpacks at a time
_ENTRIES = 1 << 17  # products at a time, which a core keeps in its cache


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, flat values) of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def products(sizes: np.ndarray, at: np.ndarray, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Packed rows (``sizes`` entries each, in columns ``at``) times ``right``, a bounded slice at a time."""
    out = np.zeros((len(sizes), right.shape[1]))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        begin = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + max(1, _ENTRIES // max(1, right.shape[1])), side="right")))
        part = slice(begin, ends[hi - 1])
        filled = np.flatnonzero(sizes[lo:hi])
        if len(filled):
            first = (ends[lo:hi] - sizes[lo:hi])[filled] - begin
            out[lo + filled] = np.add.reduceat(right[at[part]] * weight[part, None], first, axis=0)
        lo = hi
    return out


@dataclass(frozen=True)
class Numbered:
    """Both packings of the entries: by row of the small side and by row of the other side."""

    keys: DataFrame  # (i, key columns of the small side)
    small: DataFrame  # (i, at, weights): rows of the small side, ``at`` the numbers of the other
    other: DataFrame  # (j, at, weights): rows of the other side, ``at`` the numbers of the small
    other_keys: DataFrame
    n: int
    n_other: int


def _numbers(entries: DataFrame, keys: list[str], name: str, n: int) -> tuple[DataFrame, bool]:
    """``(keys, name)``, and whether the one key column counts 0 .. n - 1 and so is its own number."""
    own = entries.select(*keys).distinct()
    if len(keys) == 1 and entries.schema[keys[0]].dataType == T.LongType():
        key = F.col(keys[0])
        low, high, missing = entries.agg(F.min(key), F.max(key), F.count_if(key.isNull())).first()
        if (low, high, missing) == (0, n - 1, 0):
            return materialize(own.withColumn(name, key)), True
    return materialize(with_global_index(own, [F.col(c) for c in keys], name)), False


def numbered(entries: DataFrame, keys: list[str], other_keys: list[str], n: int, n_other: int) -> Numbered:
    """Pack ``entries`` (keys of both sides, weight), a written table, by both sides.

    A side whose key is its number already needs no join; the other one is then joined by packed row.
    The second packing is made out of the first.
    """
    own, own_done = _numbers(entries, keys, "i", n)
    theirs, theirs_done = _numbers(entries, other_keys, "j", n_other)
    by_other = own_done and not theirs_done
    row, at = ("j", "i") if by_other else ("i", "j")
    row_keys, row_numbers = (other_keys, theirs) if by_other else (keys, own)
    at_keys, at_numbers, done = (keys, own, own_done) if by_other else (other_keys, theirs, theirs_done)
    placed = entries.withColumn(at, F.col(at_keys[0])) if done else entries.join(at_numbers, at_keys)

    def packed(rows: DataFrame, by: list[str], at: str) -> DataFrame:
        listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, "weight"))).alias("v"))
        return listed.select(*by, F.col(f"v.{at}").alias("at"), F.col("v.weight").alias("weights"))

    first = materialize(packed(placed, row_keys, at).join(row_numbers, row_keys).select(row, "at", "weights"))
    entry = F.inline(F.arrays_zip("at", "weights")).alias(at, "weight")
    second = materialize(packed(first.select(row, entry), [at], row))
    small, other = (second, first) if by_other else (first, second)
    return Numbered(own, small, other, theirs, n, n_other)


def _times(right: np.ndarray, key: str):
    def multiply(batches):
        for batch in batches:
            sizes, at = lists(batch.column(1))
            weight = lists(batch.column(2))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(products(sizes, at, weight, right))], [key, "v"])

    return multiply


def multiplied(rows: DataFrame, key: str, right: np.ndarray) -> DataFrame:
    """``(key, v)``: each packed row times ``right``, whose size the caller bounds."""
    return rows.select(key, "at", "weights").mapInArrow(_times(right, key), f"{key} long, v array<double>")


def _gathered(rows: DataFrame, key: str, n: int, width: int) -> np.ndarray:
    got, out = rows.toArrow(), np.zeros((n, width))
    if got.num_rows:
        out[got.column(key).to_numpy()] = lists(got.column("v"))[1].reshape(-1, width)
    return out


def _block_product(size: int):
    def product(table: pa.Table) -> pa.Table:
        i, block = table.column("i").to_numpy(), table.column("i").to_numpy() // size
        sizes, at = lists(table.column("at"))
        weight = lists(table.column("weights"))[1]
        row = np.repeat(np.arange(len(i)), sizes)
        local, column = np.unique(at, return_inverse=True)
        low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        order = np.argsort(column, kind="stable")
        row, column, weight = row[order], column[order], weight[order]
        total = np.zeros((len(low), len(high)))
        for c in range(0, len(local), _CHUNK):
            part = slice(*np.searchsorted(column, [c, c + _CHUNK]))
            dense = np.zeros((len(i), min(_CHUNK, len(local) - c)))
            dense[row[part], column[part] - c] = weight[part]
            total += dense[low] @ dense[high].T
        long = np.tile(i[high], len(low)).reshape(len(low), len(high))
        return pa.table({"i": pa.array(i[low]), "k": as_lists(long), "v": as_lists(total)})

    return product


def gram(rows: DataFrame, n: int, cores: int) -> np.ndarray:
    """Inner products of all pairs of the ``n`` packed rows ``(i, at, weights)``.

    Rows meet in pairs of blocks; a row goes to as many groups as there are blocks, sixteen at most.
    """
    blocks = max(1, min(16, math.ceil(math.sqrt(2 * cores)), math.ceil(n / 64)))
    size = math.ceil(n / blocks)
    own = F.floor(F.col("i") / size).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.least(own, b) * blocks + F.greatest(own, b)))
    dealt = rows.select("i", "at", "weights", pair.alias("pair"))
    got = dealt.groupBy("pair").applyInArrow(_block_product(size), "i long, k array<long>, v array<double>").toArrow()
    out = np.zeros((n, n))
    i = got.column("i").to_numpy()
    sizes, k = lists(got.column("k"))
    out[np.repeat(i, sizes), k] = lists(got.column("v"))[1]
    upper = np.triu(out)
    return upper + np.triu(upper, 1).T


def by_gram(data: Numbered, k: int, cores: int) -> tuple[np.ndarray, np.ndarray]:
    """Left factor (n x k, orthonormal) and singular values, largest first."""
    values, vectors = np.linalg.eigh(gram(data.small, data.n, cores))
    return vectors[:, ::-1][:, :k], np.sqrt(np.maximum(values[::-1][:k], 0))


def by_lanczos(
    data: Numbered, k: int, seed: int, tolerance: float, most: int, budget: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by block Lanczos, up to a basis of ``most`` columns, with the residual of each pair.

    A residual is relative to the squared singular value; the relative error of the latter is below
    it, and of second order in it where the values stand apart.  It ends when all are within
    ``tolerance``, the space is used up, or ``budget`` columns (``most`` by default) were multiplied.
    With a budget above ``most`` a full basis is cut down to its leading vectors and goes on.
    """
    budget = budget or most
    step = min(_COLUMNS, max(1, SLICE_VALUES // max(data.n, data.n_other)))
    if budget > most:
        step = min(step, max(1, (most - k) // 4))
    rng = np.random.default_rng(seed)
    basis, image = np.empty((data.n, most)), np.empty((data.n, most))
    block, width, look, tried = np.linalg.qr(rng.normal(size=(data.n, step)))[0], 0, min(2 * k, most), 0
    while True:
        across = _gathered(multiplied(data.other, "j", block), "j", data.n_other, block.shape[1])
        applied = _gathered(multiplied(data.small, "i", across), "i", data.n, block.shape[1])
        new = slice(width, width + block.shape[1])
        basis[:, new], image[:, new], width = block, applied, new.stop
        tried += block.shape[1]
        own = basis[:, :width]
        rest = applied - own @ (own.T @ applied)
        rest -= own @ (own.T @ rest)
        spent = tried >= budget or width == data.n or np.linalg.norm(rest) <= 1e-12 * np.linalg.norm(applied)
        if width >= look or spent:
            small = own.T @ image[:, :width]
            values, turned = np.linalg.eigh((small + small.T) / 2)
            turned = turned[:, ::-1]
            values, vectors = values[::-1][:k], turned[:, :k]
            spread = np.linalg.norm(image[:, :width] @ vectors - (own @ vectors) * values, axis=0)
            real = values > values[0] * 1e-13 * data.n
            residual = np.where(real, spread / np.where(real, values, 1.0), 0.0)
            if spent or residual.max() <= tolerance:
                return own @ vectors, np.sqrt(np.maximum(values, 0)), residual
            if width == most:
                width = k + (most - k) // 2
                basis[:, :width], image[:, :width] = own @ turned[:, :width], image[:, :most] @ turned[:, :width]
                own = basis[:, :width]
            look = min(width + 4 * step, most)
        block = np.linalg.qr(rest)[0][:, : min(step, most - width)]
        block -= own @ (own.T @ block)
        block = np.linalg.qr(block)[0]


def stored(spark, key: str, left: np.ndarray) -> DataFrame:
    """``(key, v)`` of the rows of ``left``, written a bounded number of values at a time."""
    step = max(1, SLICE_VALUES // max(1, left.shape[1]))
    parts = [
        materialize(spark.createDataFrame(pa.table({key: pa.array(np.arange(lo, min(lo + step, len(left)))), "v": as_lists(left[lo : lo + step])})))
        for lo in range(0, len(left), step)
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def across(data: Numbered, left: np.ndarray) -> DataFrame:
    """``(j, v)``: rows of the other side times ``left``, by slices of its columns."""
    step = max(1, SLICE_VALUES // max(1, len(left)))
    if left.shape[1] <= step:
        return multiplied(data.other, "j", left)
    parts = [multiplied(data.other, "j", left[:, c : c + step]).withColumn("c", F.lit(c)) for c in range(0, left.shape[1], step)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("c", "v")))
    return whole.groupBy("j").agg(F.flatten(F.transform(ordered, lambda x: x["v"])).alias("v"))
