"""One of each group of near copies: texts whose five-word shingles have a Jaccard of 0.8 or more.

Texts whose SimHash fingerprints, of the same shingles, differ in two bits or fewer are found first, as
op3 finds them: in blocks of equal bytes, by the distances to its references.  The pairs that its
forest of links proposes are judged by their whole texts, and those that are near copies make the
first components.  But fingerprints of near copies differ by up to a third of their bits, and no equal
run of bits is left to meet in; so the others meet in shingles, without loss.  All shingles stand in one global order,
rarest first; two texts at 0.8 or more share one of the first n - ceil(0.8 n) + 1 of their n.  How
rare a shingle is comes from counters that shingles share by hash; they only set the order, and any
order finds every pair.  The keys are dealt by range, so a common shingle spans tasks.  Shingles are told apart by 64 bits of hash up to here.  Of the
candidates those go whose parity bits (each shingle turns one over) differ more often than shingles
of near copies can, which loses none; each other one is judged by the shingles of both whole texts.

In a group of many copies each text is judged against one head of each shingle first, in a few rounds
with other heads, and only in keys that several components share; then come the pairs that are still
in different components, so that a group of mutual copies does not list its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import connected_components, shuffle_width
from linkloom.llm.simhash import fingerprint_links, fingerprint_of
from linkloom.runtime import discard, materialize, scratch

SHINGLE_WORDS = 5
#: Least Jaccard of near copies, as a fraction.
SHARE = (4, 5)
COUNTERS = 1 << 16
#: Longs of a text's parity bits: each shingle turns one bit over.
PARITY = 8
#: Rounds in which each text meets one head of each key, before all other pairs are listed.
ROUNDS = 3


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> set[bytes]:
    """All runs of ``words`` words; a shorter text is one shingle, one without words the empty one."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    if len(parts) <= words:
        return {joined}
    ends = np.cumsum(sizes + 1) - 1
    return {joined[a:b] for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())}


def are_copies(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def _hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text)], np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, (_hashes(text.as_py()) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["counter", "n"])


def counters(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each counter; a fixed number of rows for the driver."""
    rows = texts.mapInArrow(_count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _prefixes(counts: np.ndarray):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = batch.column(0).to_numpy(), []
            sizes = np.zeros(len(nodes), np.int64)
            for k, text in enumerate(batch.column(1)):
                h = _hashes(text.as_py())
                n = sizes[k] = len(h)
                first = np.lexsort((h, counts[(h % np.uint64(COUNTERS)).astype(np.int64)]))[: n - -(-SHARE[0] * n // SHARE[1]) + 1]
                keys.append(h[first].view(np.int64))
            if not keys:
                continue
            long = np.array([len(x) for x in keys])
            places = np.concatenate([np.arange(x) for x in long])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, long)), pa.array(np.repeat(sizes, long), pa.int32()), pa.array(places, pa.int32())],
                ["key", "node", "size", "place"],
            )

    return prefixes


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those with a neighbour of the same key, and the first and last row."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        same = key[1:] == key[:-1]
        good = np.zeros(len(key), bool)
        good[1:] |= same
        good[:-1] |= same
        if held is None:
            good[0] = True
        else:
            good[0] |= first
        yield whole.slice(0, len(key) - 1).filter(pa.array(good[:-1]))
        first = bool(good[-1])  # the last row is judged with the next batch
        held = whole.slice(len(key) - 1)
    if held is not None:
        yield held


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, fps, bits = [], [], np.zeros((batch.num_rows, PARITY * 64), np.uint8)
        for k, text in enumerate(batch.column(1)):
            h = _hashes(text.as_py())
            sizes.append(len(h))
            fps.append(fingerprint_of(h))
            bits[k] = np.bincount((h >> np.uint64(40)).astype(np.int64) % (PARITY * 64), minlength=PARITY * 64) & 1
        packed = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in packed.T]],
            ["node", "size", "fp", *[f"p{j}" for j in range(PARITY)]],
        )


def _possible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs but for those whose parity bits differ more often than the shingles of near copies can."""
    u = parities.select(F.col("node").alias("u"), F.col("size").alias("n"), *[F.col(f"p{j}").alias(f"u{j}") for j in range(PARITY)])
    v = parities.select(F.col("node").alias("v"), F.col("size").alias("m"), *[F.col(f"p{j}").alias(f"v{j}") for j in range(PARITY)])
    differ = " + ".join(f"bit_count(u{j} ^ v{j})" for j in range(PARITY))
    most = f"{SHARE[1] - SHARE[0]} * (n + m)"
    return materialize(pairs.join(u, "u").join(v, "v").where(f"{sum(SHARE)} * ({differ}) <= {most}").select("u", "v"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, own, good = None, set(), []
        for a, b in zip(batch.column(2), batch.column(3)):
            b = b.as_py()
            if last is None or b != last[0]:
                last, own = (b,), shingles(b)
            good.append(are_copies(shingles(a.as_py()), own))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)``, a written table, whose whole texts are near copies.

    A head stands in ``v``, which comes last: its text is shipped to a task once for all its partners.
    Only texts that some pair names are joined with the pairs.
    """
    named = materialize(pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct())
    own = materialize(texts.select("rid", "text").join(named, "rid", "left_semi"))
    u = own.select(F.col("rid").alias("u"), F.col("text").alias("a"))
    v = own.select(F.col("rid").alias("v"), F.col("text").alias("b"))
    good = materialize(pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b").mapInArrow(_judge, "u long, v long"))
    discard(named, own)
    return good


_KEYS = "key long, node long, size int, place int"
_FITS = f"{SHARE[1]} * least({{a}}, {{b}}) >= {SHARE[0]} * greatest({{a}}, {{b}})"


def _mixed(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows of keys that texts of several components share, with their component, written."""
    marked = materialize(
        rows.join(tree, "node", "left").select("key", "node", "size", "place", F.coalesce("component", "node").alias("component"))
    )
    keys = materialize(marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    mixed = materialize(marked.join(keys, "key"))
    discard(marked, keys)
    return mixed


def _with_heads(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs ``(u, v)`` of each text with one head of each of its keys, if that is in another component.

    The head is the text with the fewest rarer shingles, which has the fewest edits of its own.  In
    later rounds a component is drawn by ``seed``, each counting once, and this text of it taken.
    """
    by = [F.xxhash64(F.lit(seed), "component").alias("drawn")] if seed else []
    heads = materialize(rows.groupBy("key").agg(F.min(F.struct(*by, "place", F.xxhash64("node").alias("h"), "node", "size", "component")).alias("head")))
    return (
        rows.join(heads, "key")
        .where(F.col("component") != F.col("head.component"))
        .where(_FITS.format(a="size", b="head.size"))
        .select(F.col("node").alias("u"), F.col("head.node").alias("v"))
        .distinct()
    )


def _others(rows: DataFrame) -> DataFrame:
    """Pairs of different components that share a key, are alike in size and have enough shingles after it."""
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "place", "component")]) for x in "ab")
    after = "least(size_a - place_a, size_b - place_b)"  # shared at most, if the key is the first that both have
    return (
        a.join(b, "key")
        .where("component_a < component_b")
        .where(_FITS.format(a="size_a", b="size_b"))
        .where(f"{sum(SHARE)} * ({after}) >= {SHARE[0]} * (size_a + size_b)")
        .select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
        .distinct()
    )


def _fingerprint_pairs(parities: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` that connect the texts whose fingerprints are equal or linked: no more than texts."""
    heads = materialize(parities.groupBy("fp").agg(F.min("node").alias("head")))
    linked = materialize(fingerprint_links(heads.select("fp")).distinct())
    u, v = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "uv")
    between = linked.join(u, "u").join(v, "v").select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    equal = parities.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    return equal.unionByName(between)


def links(texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all near copies of ``texts(rid, text)``, a written table."""
    spark = texts.sparkSession
    fields = "node long, size int, fp long, " + ", ".join(f"p{j} long" for j in range(PARITY))
    parities = materialize(texts.select("rid", "text").mapInArrow(_parities, fields))
    tree = texts.select(F.col("rid").alias("node"), F.col("rid").alias("component")).limit(0)
    near = judged = tree.select(F.col("node").alias("u"), F.col("component").alias("v"))
    rows = None
    for seed in range(-1, ROUNDS + 1):
        with scratch(spark) as keep:
            if seed < 0:
                pairs = _fingerprint_pairs(parities)
            else:
                if rows is None:
                    keys = texts.select("rid", "text").mapInArrow(_prefixes(counters(texts.select("text"))), _KEYS)
                    rows = materialize(
                        keys.repartitionByRange(shuffle_width(texts), "key", "node").sortWithinPartitions("key", "node").mapInArrow(_common, _KEYS)
                    )
                mixed = keep(_mixed(rows.select("key", "node", "size", "place"), tree))
                discard(rows)
                rows = mixed
                pairs = _with_heads(rows, seed) if seed < ROUNDS else _others(rows)
            new = keep(materialize(pairs.join(judged, ["u", "v"], "left_anti")))
            found = keep(_verified(_possible(new, parities), texts))
            judged, near = judged.unionByName(new), near.unionByName(found)
            if seed < ROUNDS:
                tree = keep(materialize(connected_components(near)))
    return near


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with the input's columns, of which one stays in each component of near copies.

    The row with the smallest id stays, null ids rank last; of several rows with that id one.  Null
    texts and texts without words are copies of each other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    staged = materialize(docs.select(row.alias("row")).withColumn("rid", F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as keep:
        tree = materialize(connected_components(links(staged.select("rid", F.col("row").getField(text_col).alias("text")))))
        marked = materialize(
            staged.select("rid", F.col("row").getField(id_col).alias("doc_id")).join(tree.withColumnRenamed("node", "rid"), "rid")
        )
        best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
        stays = marked.groupBy("component").agg(best.alias("best")).select(F.col("best.rid").alias("rid"))
        goes = keep(materialize(marked.select("rid").join(stays, "rid", "left_anti")))
    return staged.join(goes, "rid", "left_anti").select("row.*")
