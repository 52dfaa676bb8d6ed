"""Quality by importance resampling over hashed n-grams.

Two generative models of a document's set of hashed n-grams are fitted by grouped aggregation: the
raw one on all documents, the target one on documents labelled as good, ``TARGET_SAMPLE`` at most.
The raw corpus contains the target, so no n-gram can be much likelier in the target, and ratios above
one are taken as one.  Below one, an n-gram's log ratio is kept where the target has it at a tenth
of the raw rate or less and its count falls short by more than chance allows; else it is zero, so a
long clean text, or one in a rare language, does not gather noise.  A document's log weight is the
sum over its n-grams.  Documents are sampled without replacement by Gumbel top-k: the k largest of
sharpened log weight plus Gumbel noise.  k is the number of documents whose weight reaches the
cut-off that separates labelled good and bad documents best.

N-grams: byte 4-grams (marks, letter case, layout), words in lower case, and the share of words that
repeat the word before them.  The driver sees the significant entries of a model of fixed size, a
histogram of fixed size and counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

BITS = 18
SIZE = 1 << BITS
BYTES = 4
REPEAT_STEPS = 5
ENTRIES = 2 * SIZE + REPEAT_STEPS + 1
#: A ratio counts from this many standard errors on.
SIGNIFICANCE = 5.0
PSEUDO_COUNT = 0.5
#: ... and when the target has the n-gram at most at this share of the raw rate.
DEPLETED = 0.1
#: Power of the importance weights; noise then decides between near-equal documents only.
SHARPNESS = 4.0
SEED = 8
#: The target model is fitted on at most this many good documents, in hash order of their ids.
TARGET_SAMPLE = 50_000
#: Histogram of labelled weights: steps of this width up to this size on either side.
STEP, SPAN = 0.25, 60.0
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) >= BYTES:
        h = x[: len(x) - BYTES + 1].copy()
        for i in range(1, BYTES):
            h |= x[i : len(x) - BYTES + 1 + i] << np.uint32(8 * i)
        h = np.unique(h) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        grams = np.unique(h >> np.uint32(32 - BITS)).astype(np.int64)
    else:
        grams = np.empty(0, np.int64)
    digest = xxhash.xxh32_intdigest
    words = {digest(w) >> (32 - BITS) for w in set(_WORD.findall((text or "").lower()))}
    parts = data.split()
    repeats = sum(map(bytes.__eq__, parts, parts[1:]))
    step = 2 * SIZE + (REPEAT_STEPS * repeats) // max(1, len(parts))
    return np.concatenate([grams, SIZE + np.fromiter(words, np.int64, len(words)), [step]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(ENTRIES, np.int64), np.zeros(ENTRIES, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = features(text)
            raw[found] += 1
            if good:
                target[found] += 1
    seen = np.flatnonzero(raw)
    for k in range(0, len(seen), 1 << 16):
        part = seen[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], ["gram", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The significant log ratios, zero elsewhere; ``labels(id, good)`` has one row per id."""
    target = labels.where("good").orderBy(F.xxhash64("id"), "id").limit(TARGET_SAMPLE).withColumnRenamed("good", "target")
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(target), "id", "left")
    counts = marked.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(
        _count, "gram long, raw long, target long"
    )
    total = marked.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("target"), 1)).alias("good")).first()
    ratios = np.zeros(ENTRIES, np.float32)
    if not total["good"]:
        return ratios
    share = total["good"] / total["n"]
    expected = F.col("raw") * F.lit(share)
    found = (
        counts.groupBy("gram")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .where(F.col("target") <= F.lit(DEPLETED) * expected)
        .where(expected - F.col("target") > F.lit(SIGNIFICANCE) * F.sqrt(expected * F.lit(1 - share)))
        .select("gram", F.log((F.col("target") + PSEUDO_COUNT) / (expected + PSEUDO_COUNT)).alias("ratio"))
        .toArrow()
        .to_pandas()
    )
    ratios[found["gram"].to_numpy()] = found["ratio"].to_numpy()
    return ratios


def _scorer(ratios: np.ndarray, text_at: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(ratios[features(t)].sum(dtype=np.float64)) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], [*batch.schema.names, "log_weight"])

    return score


def cut_off(scored: DataFrame) -> float:
    """The weight that separates ``good`` from bad best: the middle of the best stretch.

    Separation is the share of good documents kept plus the share of bad ones dropped.
    """
    step = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("log_weight")))
    rows = (
        scored.where("good IS NOT NULL")
        .groupBy(F.floor(step / STEP).cast("int").alias("step"))
        .agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
        .orderBy("step")
        .collect()
    )
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return -np.inf
    lowest = int(-SPAN / STEP)
    table = {r.step: (r.good, r.bad) for r in rows}
    best, held, dropped, kept = (-1.0, 0, 0), 0, 0, good
    for step in range(lowest, -lowest + 1):
        value = kept / good + dropped / bad  # the cut lies just below this step
        if value > best[0] + 1e-12:
            best = (value, step, step)
        elif value > best[0] - 1e-12 and best[2] == step - 1:
            best = (best[0], best[1], step)
        g, b = table.get(step, (0, 0))
        kept, dropped = kept - g, dropped + b
    return STEP * (best[1] + best[2]) / 2


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 4096) -> float:
    """The k-th largest value, by narrowing histograms of fixed size."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside, left = rows.select(column), k
    while True:
        n = inside.count()
        if n <= few or low >= high:
            values = sorted((r[0] for r in inside.limit(few).collect()), reverse=True)
            return values[min(left, len(values)) - 1]
        width = (high - low) / 1024
        part = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int"))
        bins = inside.groupBy(part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if left <= r.n:
                break
            left -= r.n
        low, high = r.lo, r.hi
        inside = inside.where(F.col(column).between(low, high))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled input rows, with ``log_weight`` and ``gumbel_key`` after the input's columns.

    ``labels(doc_id, quality, toxic)``: good is quality 1 and not toxic; null values, null ids and
    contradictory repeated labels do not count.  Documents with null or empty texts have only the
    n-gram "no repeats" and are judged by it.  Rows that share an id are judged by their own text;
    equal rows have equal keys and stay or go together.  Without good or without bad labels all rows
    stay.  An empty table gives an empty result.  The input must not have the two added columns.
    """
    verdict = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).otherwise((F.col("quality") == 1) & (F.col("toxic") == 0))
    known = materialize(
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min(verdict).alias("low"), F.max(verdict).alias("high"))
        .where("low = high")
        .select("id", F.col("low").alias("good"))
    )
    ratios = log_ratios(docs, known, id_col, text_col)
    columns = docs.schema.fields
    schema = type(docs.schema)([*columns]).add("log_weight", "double")
    scored = docs.mapInArrow(_scorer(ratios, docs.columns.index(text_col)), schema)
    return _sample(scored, known, id_col)


def _sample(scored: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = materialize(scored.withColumn("gumbel_key", F.col("log_weight") * SHARPNESS - F.log(-F.log(u))))
    slim = keyed.select(F.col(f"`{id_col}`").alias("id"), "log_weight", "gumbel_key")
    limit = cut_off(slim.join(known, "id"))
    k = slim.where(F.col("log_weight") >= limit).count()
    if not k:
        return keyed.limit(0)
    return keyed.where(F.col("gumbel_key") >= kth_largest(slim, "gumbel_key", k))
