"""Cosine of known links and their rank among all candidate articles.

The rank of a link is one plus the number of articles that score higher for its page, so pairs
are counted and never emitted.  Links are cut into slices of a bounded number of vector entries; a
slice is broadcast and the articles are scanned where they lie, each task returning one number per
link.  Articles are never copied for the links, and memory per task does not depend on the data, on
frequent terms or on popular pages; the number of scans grows with the links.  Every pair is still
scored, so the work grows with links times articles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.smallside import as_lists, lists
from linkloom.runtime import materialize

DECIMALS = 9
SLICE_ENTRIES = 1 << 21  # of the links that are broadcast at a time
ARTICLES_PER_TASK = 8192
LINKS_AT_ONCE = 256  # whose vectors a task compares
_CELLS_AT_ONCE = 1_000_000
_SINGLES_AT_ONCE = 1 << 22  # pairs of a block in single precision
_SHARED_AT_ONCE = 1 << 15  # pairs that share less frequent terms
_DENSE_SHARE = 1 / 1000
_MOST_DENSE_TERMS = 4096
_GROUPS = 6  # of alike pages in a slice
_HEAD_TERMS = 512  # that groups are told apart by
_OPEN_SHARE = 1 / 200  # of a block's pairs that are scored again one by one


def _rows(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _entries(terms, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of Arrow lists, rows scaled to unit length; zero vectors stay zero."""
    sizes, ids = lists(terms)
    weight = lists(weights)[1].astype(np.float64)
    row = _rows(sizes)
    norms = np.sqrt(np.bincount(row, weight * weight, len(sizes)).astype(np.float64))
    norms[norms == 0] = 1.0
    return row, ids.astype(np.int64), weight / norms[row]


def _cosines(batch: pa.RecordBatch) -> np.ndarray:
    """Cosine of the two vectors of each row; an empty one scores 0."""
    row, term, weight = _entries(batch.column("terms"), batch.column("weights"))
    other_row, other_term, other_weight = _entries(batch.column("pm_terms"), batch.column("pm_weights"))
    ids, code = np.unique(np.concatenate([term, other_term]), return_inverse=True)
    key, other = row * len(ids) + code[: len(term)], other_row * len(ids) + code[len(term) :]
    _, left, right = np.intersect1d(key, other, assume_unique=True, return_indices=True)
    return np.bincount(row[left], weight[left] * other_weight[right], batch.num_rows).astype(np.float64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is worked out of one stays small beside the batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, LINKS_AT_ONCE):
            yield batch.slice(lo, LINKS_AT_ONCE)


def _score_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        cos = np.round(_cosines(batch), DECIMALS)
        columns = [batch.column("web_id"), batch.column("pmid"), pa.array(cos), batch.column("terms"), batch.column("weights")]
        yield pa.RecordBatch.from_arrays(columns, ["web_id", "pmid", "cos", "terms", "weights"])


def score_links(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(web_id, pmid, cos, terms, weights): cosine of each known link and the page's vector.

    Pages or articles without a vector score 0.
    """
    web = vectors.where(F.col("side") == "web").select(F.col("id").alias("web_id"), "terms", "weights")
    pm = vectors.where(F.col("side") == "pm").select(
        F.col("id").alias("pmid"), F.col("terms").alias("pm_terms"), F.col("weights").alias("pm_weights")
    )
    joined = links.select("web_id", "pmid").join(web, "web_id", "left").join(pm, "pmid", "left")
    empty = {"terms": "array<long>", "weights": "array<double>", "pm_terms": "array<long>", "pm_weights": "array<double>"}
    ordered = joined.select("web_id", "pmid", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()])
    return ordered.mapInArrow(_score_known, "web_id long, pmid long, cos double, terms array<long>, weights array<double>")


def _block_scores(q, a, n_q: int, n_a: int):
    """Yield article x query score slices of bounded size."""
    (q_row, q_term, q_w), (a_row, a_term, a_w) = q, a
    local, q_at = np.unique(q_term, return_inverse=True)
    a_at = np.minimum(np.searchsorted(local, a_term), max(len(local) - 1, 0))
    known = local[a_at] == a_term if len(local) else np.zeros(len(a_term), bool)
    a_row, a_at, a_w = a_row[known], a_at[known], a_w[known]
    q_df = np.bincount(q_at, minlength=len(local))
    a_df = np.bincount(a_at, minlength=len(local))
    density = (q_df / n_q) * (a_df / n_a)
    frequent = np.argsort(-density, kind="stable")[:_MOST_DENSE_TERMS]
    frequent = frequent[density[frequent] > _DENSE_SHARE]
    column = np.full(len(local), -1)
    column[frequent] = np.arange(len(frequent))

    in_q = column[q_at] >= 0
    dense_q = np.zeros((len(frequent), n_q))
    dense_q[column[q_at[in_q]], q_row[in_q]] = q_w[in_q]
    order = np.argsort(q_at[~in_q], kind="stable")
    post_row, post_w = q_row[~in_q][order], q_w[~in_q][order]
    post_len = np.bincount(q_at[~in_q], minlength=len(local))
    post_start = np.concatenate([[0], np.cumsum(post_len)])

    step = max(1, _SINGLES_AT_ONCE // n_q)
    for lo in range(0, n_a, step):
        hi = min(lo + step, n_a)
        begin, end = np.searchsorted(a_row, [lo, hi])
        row, at, weight = a_row[begin:end] - lo, a_at[begin:end], a_w[begin:end]
        dense = column[at] >= 0
        left = np.zeros((hi - lo, len(frequent)))
        left[row[dense], column[at[dense]]] = weight[dense]
        scores = left @ dense_q
        _add_shared(scores, row[~dense], at[~dense], weight[~dense], post_start, post_len, post_row, post_w)
        yield scores


@dataclass(frozen=True)
class _Links:
    """The links of a slice in groups of alike pages, and their vectors' entries by group and term.

    Groups are only there for speed: a block of one group of links and one of articles takes its own
    frequent terms, and pages that share few words with an article cost little.
    """

    goal: np.ndarray
    terms: np.ndarray  # that occur, ascending; entries carry their places
    bounds: np.ndarray  # first link of each group
    cuts: np.ndarray  # first entry of each group
    row: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    by_row: np.ndarray  # the entries in the order of links and terms
    sizes: np.ndarray  # entries of each link
    head: np.ndarray  # column of each term in ``centres``, or -1
    centres: np.ndarray
    signed: bool


def _heads(row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, column: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.float32)
    inside = column[at] >= 0
    out[row[inside], column[at[inside]]] = weight[inside]
    return out


def _centres(heads: np.ndarray) -> np.ndarray:
    """Directions of at most ``_GROUPS`` groups of alike rows, none of them of few rows."""
    scale = np.sqrt(np.einsum("ij,ij->i", heads, heads))
    rows = heads[scale > 0] / scale[scale > 0, None]
    if not len(rows):
        return np.zeros((heads.shape[1], 1), np.float32)
    found = rows[np.random.default_rng(1).permutation(len(rows))[: 4 * _GROUPS]]
    for most in [*range(4 * _GROUPS, _GROUPS, -4), *[_GROUPS] * 3]:
        own = (rows @ found.T).argmax(axis=1)
        sizes = np.bincount(own, minlength=len(found))
        kept = [g for g in np.argsort(-sizes, kind="stable")[:most] if sizes[g] * 4 * _GROUPS >= len(rows) or sizes[g] == sizes.max()]
        found = np.vstack([rows[own == g].mean(axis=0) for g in kept])
        found /= np.maximum(np.sqrt(np.einsum("ij,ij->i", found, found)), np.finfo(np.float32).tiny)[:, None]
    return np.ascontiguousarray(found.T)


def _grouped(part: pa.Table) -> tuple[_Links, pa.Table]:
    """The slice as ``_Links``, and its ids in their order."""
    goal = np.rint(part.column("cos").to_numpy() * 10**DECIMALS)
    row, term, weight = _entries(part.column("terms"), part.column("weights"))
    terms, at = np.unique(term, return_inverse=True)
    df = np.bincount(at, minlength=len(terms))
    most = np.argsort(-df, kind="stable")[:_HEAD_TERMS]
    head = np.full(len(terms), -1, np.int32)
    head[most] = np.arange(len(most))
    heads = _heads(row, at, weight, len(goal), head, len(most))
    centres = _centres(heads)
    group = (heads @ centres).argmax(axis=1) if len(most) else np.zeros(len(goal), np.int64)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[row]
    n_groups = np.arange(centres.shape[1] + 1)
    entry = np.lexsort((row, at, group[order][row]))
    row, at, weight = row[entry].astype(np.int32), at[entry].astype(np.int32), weight[entry]
    links = _Links(
        goal[order], terms, np.searchsorted(group[order], n_groups), np.searchsorted(group[order][row], n_groups), row, at, weight,
        np.lexsort((at, row)).astype(np.int32), np.bincount(row, minlength=len(order)), head, centres, bool((weight < 0).any()),
    )
    return links, part.select(["web_id", "pmid", "cos"]).take(pa.array(order))


def _exact(links: _Links, ends: np.ndarray, link: np.ndarray, article: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which of the pairs score above the link's goal, by all their entries in double precision."""
    good = np.zeros(len(link), bool)
    sizes, n = links.sizes[link], max(1, len(links.terms))
    slot = np.cumsum(sizes) // _CELLS_AT_ONCE
    for part in np.split(np.arange(len(link)), np.flatnonzero(np.diff(slot)) + 1):
        times = sizes[part]
        pair, total = np.repeat(np.arange(len(part)), times), int(times.sum())
        first = np.cumsum(times) - times
        entry = links.by_row[np.arange(total) + np.repeat(ends[link[part]] - times - first, times)]
        wanted = article[part][pair] * n + links.at[entry]
        found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        both = keys[found] == wanted if len(keys) else np.zeros(total, bool)
        score = np.bincount(pair[both], links.weight[entry[both]] * weights[found[both]], len(part))
        good[part] = np.rint(score * 10**DECIMALS) > links.goal[link[part]]
    return good


def _above_in_block(links: _Links, g: int, ends: np.ndarray, a_row: np.ndarray, a_at: np.ndarray, a_w: np.ndarray, n_a: int) -> np.ndarray:
    """For each link of group ``g``: how many of the articles, numbered 0 to ``n_a`` - 1, score above it.

    Terms frequent on both sides go through one dense product in single precision; all others only
    touch the pairs that share them.  What its rounding leaves open is scored again in double; a block
    of many such pairs, as among copies, is done in double from the start.
    """
    own, some = slice(links.bounds[g], links.bounds[g + 1]), slice(links.cuts[g], links.cuts[g + 1])
    q_row, q_at, q_w = links.row[some] - links.bounds[g], links.at[some], links.weight[some]
    goal, n_q, n_terms = links.goal[own], own.stop - own.start, len(links.terms)
    q_df, a_df = np.bincount(q_at, minlength=n_terms), np.bincount(a_at, minlength=n_terms)
    density = q_df * (a_df / (n_q * n_a))
    frequent = np.flatnonzero(density > _DENSE_SHARE)
    if len(frequent) > _MOST_DENSE_TERMS:
        frequent = frequent[np.argsort(-density[frequent], kind="stable")[:_MOST_DENSE_TERMS]]
    column = np.full(n_terms, -1)
    column[frequent] = np.arange(len(frequent))
    starts, fans = np.cumsum(q_df) - q_df, np.where(column < 0, q_df, 0)
    dense_q = np.ascontiguousarray(_heads(q_row, q_at, q_w, n_q, column, len(frequent)).T)
    keys = a_row * n_terms + a_at

    limit = (goal + 0.5) / 10**DECIMALS
    slack = (links.sizes[own] + 16) * 2.0**-22 * (1.0 if links.signed else limit)
    low, high = (limit - slack).astype(np.float32), (limit + slack).astype(np.float32)
    above = np.zeros(n_q, np.int64)
    step = max(1, _SINGLES_AT_ONCE // n_q)
    for lo in range(0, n_a, step):
        hi = min(lo + step, n_a)
        begin, end = np.searchsorted(a_row, [lo, hi])
        row, at, weight = a_row[begin:end] - lo, a_at[begin:end], a_w[begin:end]
        scores = _heads(row, at, weight, hi - lo, column, len(frequent)) @ dense_q
        shared = fans[at] > 0
        _add_shared(scores, row[shared], at[shared], weight[shared], starts, fans, q_row, q_w)
        sure, most = np.count_nonzero(scores > high, axis=0), np.count_nonzero(scores >= low, axis=0)
        if (most - sure).sum() <= scores.size * _OPEN_SHARE:
            above += sure
            link = np.flatnonzero(most != sure)
            article, k = np.nonzero((scores[:, link] >= low[link]) & (scores[:, link] <= high[link]))
            good = _exact(links, ends, own.start + link[k], article + lo, keys, a_w)
            above += np.bincount(link[k[good]], minlength=n_q)
            continue
        for scores in _block_scores((q_row, q_at, q_w), (row, at, weight), n_q, hi - lo):
            above += (np.rint(scores * 10**DECIMALS) > goal).sum(axis=0)
    return above


def _add_shared(scores, row, at, weight, post_start, post_len, post_row, post_w):
    """Add the products of the less frequent terms, a bounded number of pairs at a time."""
    n_q, flat = scores.shape[1], scores.reshape(-1)
    fan = post_len[at]
    ends = np.cumsum(fan)
    shift, base = post_start[at] - (ends - fan), row * n_q
    weight, post_w = weight.astype(scores.dtype), post_w.astype(scores.dtype)
    slot = ends // _SHARED_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(at)]
    for lo, hi in zip(edges, edges[1:]):
        if lo == hi:
            continue
        times = fan[lo:hi]
        begin = ends[lo] - times[0]
        post = np.repeat(shift[lo:hi], times)
        post += np.arange(begin, ends[hi - 1])
        cell = np.repeat(base[lo:hi], times)
        cell += post_row[post]
        product = np.repeat(weight[lo:hi], times)
        product *= post_w[post]
        if not len(product):
            continue
        if scores.dtype == np.float64:
            scores += np.bincount(cell, weights=product, minlength=scores.size).reshape(scores.shape)
        else:
            np.add.at(flat, cell, product)


def _count_above(links: _Links, ids: pa.Table):
    """For each link of the slice: how many of a task's articles score above it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.zeros(len(links.goal), np.int64)
        ends = np.cumsum(links.sizes)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row, term, weight = _entries(batch.column(0), batch.column(1))
            at = np.minimum(np.searchsorted(links.terms, term), max(len(links.terms) - 1, 0))
            known = links.terms[at] == term if len(links.terms) else np.zeros(len(term), bool)
            row, at, weight = row[known], at[known], weight[known]
            group = (_heads(row, at, weight, n, links.head, len(links.centres)) @ links.centres).argmax(axis=1)
            for a in np.unique(group):
                members = group == a
                place, inside = np.cumsum(members) - 1, members[row]
                own_row, own_at, own_w = place[row[inside]], at[inside], weight[inside]
                order = np.lexsort((own_at, own_row))
                entries = own_row[order], own_at[order], own_w[order]
                for g in np.flatnonzero(np.diff(links.bounds)):
                    above[links.bounds[g] : links.bounds[g + 1]] += _above_in_block(links, g, ends, *entries, int(members.sum()))
        yield from ids.append_column("above", pa.array(above)).to_batches()

    return count


def _sliced(scored: DataFrame, entries: str) -> Iterator[pa.Table]:
    """The rows of ``scored`` in slices of about ``SLICE_ENTRIES`` entries, dealt by link."""
    total = scored.agg(F.sum(F.expr(entries).cast("long"))).first()[0]
    if total is None:
        return
    slices = max(1, math.ceil(total / SLICE_ENTRIES))
    written = materialize(scored.withColumn("_slice", F.pmod(F.xxhash64("web_id", "pmid"), F.lit(slices)).cast("int")), "_slice")
    for i in range(slices):
        part = written.where(F.col("_slice") == i).drop("_slice").toArrow()
        if part.num_rows:
            yield part


def _dealt(articles: DataFrame, *columns: str) -> DataFrame:
    """Articles spread over enough tasks, written once for all slices."""
    cores = articles.sparkSession.sparkContext.defaultParallelism
    n = max(3 * cores, math.ceil(articles.count() / ARTICLES_PER_TASK))
    return materialize(articles.select("id", *columns).repartition(n, "id")).select(*columns)


def _summed(parts: list[DataFrame], *keys: str) -> DataFrame:
    """``above`` is summed where it was counted; a slice's links are its own."""
    ranks = F.max("cos").alias("cos"), (F.sum("above") + 1).alias("rank")
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*ranks)


_COUNTS = "web_id long, pmid long, cos double, above long"


def rank_links(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(web_id, pmid, cos, rank) of every link among all articles in ``vectors``.

    ``vectors`` (side, id, terms, weights) is read several times; pass a materialized table.
    """
    articles = _dealt(vectors.where(F.col("side") == "pm"), "terms", "weights")
    parts = [vectors.sparkSession.createDataFrame([], _COUNTS)]
    for part in _sliced(materialize(score_links(links, vectors)), "size(terms) + 1"):
        parts.append(articles.mapInArrow(_count_above(*_grouped(part)), _COUNTS))
    return _summed(parts, "web_id", "pmid")


def _prefix_cosines(left: np.ndarray, right: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Cosine of each row pair at each size, (sizes, rows)."""
    dot, a, b = (np.cumsum(x * y, axis=1)[:, np.array(sizes) - 1] for x, y in ((left, right), (left, left), (right, right)))
    scale = np.sqrt(a * b)
    return np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0).T


def _count_above_at(queries: np.ndarray, goal: np.ndarray, sizes: Sequence[int], ids: pa.Table):
    """As ``_count_above`` for dense vectors, at every size in one sweep over their columns."""
    starts = [0, *sizes[:-1]]

    def lengths(x: np.ndarray) -> list[np.ndarray]:
        squares = np.cumsum([np.einsum("ij,ij->i", x[:, a:b], x[:, a:b]) for a, b in zip(starts, sizes)], axis=0)
        return [np.where(s > 0, np.sqrt(s), 1.0) for s in squares]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(queries)
        above = np.zeros(goal.shape, np.int64)
        step = max(1, _CELLS_AT_ONCE // max(1, len(queries)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.column(0).slice(lo, step)
                x = lists(part)[1].reshape(len(part), -1)
                dots = np.zeros((len(x), len(queries)))
                for k, (a, b, of_x, of_q) in enumerate(zip(starts, sizes, lengths(x), own)):
                    dots += x[:, a:b] @ queries[:, a:b].T
                    above[k] += (np.rint(dots / of_x[:, None] / of_q * 10**DECIMALS) > goal[k]).sum(axis=0)
        for k, size in enumerate(sizes):
            table = ids.append_column("size", pa.array(np.full(len(queries), size, np.int32)))
            table = table.append_column("cos", pa.array(goal[k] / 10**DECIMALS)).append_column("above", pa.array(above[k]))
            yield from table.to_batches()

    return count


def rank_prefixes(links: DataFrame, vectors: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(web_id, pmid, size, cos, rank): ranks by the first ``size`` components, for each of ``sizes``.

    ``vectors`` (side, id, vec), a materialized table, has dense vectors of the largest size or more
    for every page and article of interest.  One scan of the articles serves all sizes.  A link
    without a page or article vector has no rank.
    """
    sizes = sorted(set(sizes))
    cut = F.slice("vec", 1, sizes[-1])
    web = vectors.where(F.col("side") == "web").select(F.col("id").alias("web_id"), cut.alias("x"))
    pm = vectors.where(F.col("side") == "pm").select(F.col("id").alias("pmid"), cut.alias("y"))
    articles = _dealt(vectors.where(F.col("side") == "pm").select("id", cut.alias("vec")), "vec")
    schema = "web_id long, pmid long, size int, cos double, above long"
    parts = [vectors.sparkSession.createDataFrame([], schema)]
    pairs = links.select("web_id", "pmid").join(web, "web_id").join(pm, "pmid").select("web_id", "pmid", "x", "y")
    for part in _sliced(materialize(pairs), "2 * size(x)"):
        x, y = (lists(part.column(c))[1].reshape(part.num_rows, -1) for c in ("x", "y"))
        goal = np.rint(_prefix_cosines(x, y, sizes) * 10**DECIMALS)
        parts.append(articles.mapInArrow(_count_above_at(x, goal, sizes, part.select(["web_id", "pmid"])), schema))
    return _summed(parts, "web_id", "pmid", "size")
