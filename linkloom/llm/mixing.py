"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's target is cut into whole passes over the source and a rest.  The rest is drawn as
disjoint blocks of words: the blocks of a source are permuted by a seeded hash, and the first of
them, up to the target to the word, are in the mix.  How many blocks each output shard gets from
each source is settled exactly by a tree: a node's block quotas are split between its two halves of
shards by a multivariate hypergeometric draw, down to single shards.  Shards take consecutive runs
of a source's permutation, so what they draw is disjoint, and shuffle what they got locally.

The driver handles one number per source and per shard and source; documents and blocks stay in
Spark.  All random choices are seeded, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.shared import BLANKS
from linkloom.runtime import materialize

SHARE = 1.5
CAP = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 256
SHARDS = 16
SEED = 20
#: The table of sources is read by the driver; more sources than this are refused, not dropped.
MAX_SOURCES = 200_000


def word_count(text: Column) -> Column:
    """Runs of characters that are no ASCII blank; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets of the sources in their order; what exceeds ``cap`` times a source is shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), share * float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        above = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in above:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def _drawn(n: int, others: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` draws without replacement come from ``n`` of ``n + others`` blocks.

    Above the generator's limit of a billion the distribution is summed out from its mode, whose
    neighbours' ratios are exact, over fourteen standard deviations, and inverted.
    """
    total = n + others
    if total < 1_000_000_000:
        return int(rng.hypergeometric(n, others, take))
    low, high = max(0, take - others), min(n, take)
    mode = min(high, max(low, (n + 1) * (take + 1) // (total + 2)))
    spread = (take * (n / total) * (others / total) * ((total - take) / max(1, total - 1))) ** 0.5
    reach = int(14 * spread) + 32
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = (n - x[:-1]) * (take - x[:-1]) / ((x[:-1] + 1) * (others - take + x[:-1] + 1))  # p(x + 1) / p(x)
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(x[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(x) - 1)])


def _split(held: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """``take`` blocks drawn without replacement from sources with ``held`` blocks, by marginals."""
    out, rest = np.zeros_like(held), int(held.sum())
    for k, n in enumerate(held.tolist()):
        if take <= 0:
            break
        x = _drawn(n, rest - n, take, rng)
        out[k], take, rest = x, take - x, rest - n
    return out


def splitting_tree(quotas: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (row) in each shard (column); rows sum to the quotas, columns are even."""
    out = np.zeros((len(quotas), shards), np.int64)
    rng = np.random.default_rng(seed)
    total = int(sum(quotas))
    room = [total // shards + (k < total % shards) for k in range(shards)]
    nodes = [(0, shards, np.array(quotas, np.int64))]
    while nodes:
        lo, hi, held = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = held
            continue
        mid = (lo + hi) // 2
        left = _split(held, sum(room[lo:mid]), rng)
        nodes += [(lo, mid, left), (mid, hi, held - left)]
    return out


def _running(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Sum ``before`` and number ``rank`` of the rows that precede each row in its group.

    The rows are sorted by range over all tasks and written; the totals of a group in a partition
    are summed first, so no task gets a whole group.
    """
    placed = materialize(df.orderBy(*[F.col(k) for k in keys], *order).withColumn("_pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    totals = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, [*keys, "_part"])
        .withColumn("before", F.col("_sum0") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .withColumn("rank", F.col("_n0") + F.count(F.lit(1)).over(inside))
        .drop("_pos", "_part", "_sum0", "_n0")
    )


def plan_sources(sized: DataFrame) -> list[dict]:
    """One entry per source in code-point order, null last: number, size, target, whole passes, rest."""
    rows = (
        sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    out = []
    for number, (row, target) in enumerate(zip(rows, targets([r.size for r in rows]))):
        wanted = round(target)
        passes = wanted // row.size if row.size else 0
        out.append(
            {"number": number, "source": row.source, "source_size": row.size, "target": target, "passes": passes,
             "rest": wanted - passes * row.size if row.size else 0}
        )
    return out


_PLAN = "number int, source string, source_size long, target double, passes long, rest long"


def _plan_frame(spark: SparkSession, plan: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(p.values()) for p in plan], _PLAN)


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
            F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("content"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )


def drawn_blocks(sized: DataFrame, plan: list[dict], shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix's blocks: ``number, rid, doc_id, copy, first_word, n_words, shard, place``.

    A pass over a source takes each of its blocks once; the rest takes a prefix of the source's
    permutation, the last block of it only as far as needed.  ``place`` orders a shard.  The order
    hashes a document's id and text, so it does not depend on files or partitions; equal rows are
    neighbours in it and stand for each other.
    """
    spark = sized.sparkSession
    known = _plan_frame(spark, plan).select("number", "source", "passes", "rest")
    cut = (
        sized.where("size > 0")
        .join(F.broadcast(known), sized["source"].eqNullSafe(known["source"]))
        .select("number", "rid", "doc_id", "content", "size", "passes", "rest")
        .withColumn("first_word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_words).cast("long"))))
        .withColumn("n_words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("first_word")))
        .withColumn("mark", F.xxhash64(F.lit(seed), "number", "content", "first_word"))
        .drop("size")
    )
    ranked = materialize(_running(cut, ["number"], [F.col("mark"), F.col("rid"), F.col("first_word")], "n_words"))
    once = ranked.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    rest = ranked.where("before < rest").withColumn("copy", F.lit(0).cast("long")).withColumn(
        "n_words", F.least("n_words", F.col("rest") - F.col("before"))
    )
    per_copy = {
        (r.number, r.copy): r.n
        for r in ranked.groupBy("number")
        .agg(F.max("passes").alias("p"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") < F.col("rest"), 1)).alias("d"))
        .select("number", F.explode(F.expr("transform(sequence(0, p), c -> struct(c AS copy, if(c = 0, d, n) AS n))")).alias("e"))
        .select("number", "e.*")
        .collect()
    }
    keys = sorted(per_copy)
    shares = splitting_tree([per_copy[k] for k in keys], shards, seed) if keys else np.zeros((0, shards), np.int64)
    stops = [(n, c, np.cumsum(row).tolist()) for (n, c), row in zip(keys, shares)]
    bounds = spark.createDataFrame(stops, "number int, copy long, stops array<long>")
    drawn = once.unionByName(rest).join(F.broadcast(bounds), ["number", "copy"])
    return drawn.select(
        "number", "rid", "doc_id", "copy", "first_word", "n_words",
        F.size(F.filter("stops", lambda x: x <= F.col("rank"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "number", "content", "first_word", "copy").alias("place"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``shards``.

    ``taken`` counts the words that the mix takes, repeats included; ``shards`` lists where to.
    A null or empty text has size 0 and is not taken; null sources form one source, the last.  Rows
    that share an id, and null ids, are drawn each for itself.  A source without words has target
    0.  An empty table gives an empty result; other input columns are not read.
    """
    sized = sized_documents(docs, id_col, text_col, source_col)
    plan = plan_sources(sized)
    taken = (
        drawn_blocks(sized, plan)
        .groupBy("rid")
        .agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    )
    known = _plan_frame(sized.sparkSession, plan).select("source", "source_size", "target")
    return (
        sized.join(taken, "rid", "left")
        .join(F.broadcast(known), sized["source"].eqNullSafe(known["source"]))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, shard_tasks: int = 4) -> None:
    """Write the mixed texts, one folder per shard, each sorted by its local shuffle.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; rows that share an id, and null ids, keep
    their own words.  Blocks are cut before they move, and a shard is written by several tasks.
    """
    row = materialize(docs.select("doc_id", "text", "source").withColumn("rid", F.monotonically_increasing_id()))
    sized = materialize(
        row.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("content"), "rid")
    )
    blocks = materialize(drawn_blocks(sized, plan_sources(sized), shards).select("rid", "shard", "place", "first_word", "n_words"))
    cuts = blocks.groupBy("rid").agg(F.collect_list(F.struct("shard", "place", "first_word", "n_words")).alias("cuts"))
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), rf"[{BLANKS}]+", " ")), " ")
    cut = F.transform(
        "cuts",
        lambda b: F.struct(
            b["shard"].alias("shard"), b["place"].alias("place"),
            F.array_join(F.slice("words", b["first_word"].cast("int") + 1, b["n_words"].cast("int")), " ").alias("text"),
        ),
    )
    texts = row.select("rid", "doc_id", words.alias("words")).join(cuts, "rid").select("doc_id", F.explode(cut).alias("b"))
    out = texts.select("b.shard", "b.place", "doc_id", "b.text")
    dealt = out.repartitionByRange(shards * shard_tasks, "shard", "place").sortWithinPartitions("shard", "place")
    dealt.write.partitionBy("shard").parquet(path)
