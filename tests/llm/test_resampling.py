"""Importance resampling against brute force: features, log ratios, cut-off and Gumbel top-k."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import quality

BITS = 18


def brute_features(text):
    data, out = (text or "").encode(), set()
    for k in range(len(data) - 3):
        h = int.from_bytes(data[k : k + 4], "little") * 0x9E3779B1 % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out.add(("bytes", h >> 32 - BITS))
    out |= {("word", xxhash.xxh32_intdigest(w) >> 32 - BITS) for w in re.findall(r"[^\W_]+", (text or "").lower())}
    parts = data.split()
    return out | {("repeats", 5 * sum(a == b for a, b in zip(parts, parts[1:])) // max(1, len(parts)))}


def brute_resample(rows, good, bad, uniform):
    """``{id: (log weight, kept)}``; ids are distinct."""
    found = {i: brute_features(t) for i, t in rows}
    raw = Counter(f for fs in found.values() for f in fs)
    target = Counter(f for i in good for f in found[i])
    share, ratios = len(good) / len(rows), {}
    for f, n in raw.items():
        e = n * share
        if target[f] <= 0.1 * e and e - target[f] > 5 * math.sqrt(e * (1 - share)):
            ratios[f] = math.log((target[f] + 0.5) / (e + 0.5))
    weight = {i: sum(ratios.get(f, 0.0) for f in fs) for i, fs in found.items()}
    cuts = [k / 4 for k in range(-240, 241)]
    worth = [sum(weight[i] >= c for i in good) / len(good) + sum(weight[i] < c for i in bad) / len(bad) for c in cuts]
    first = last = next(k for k, w in enumerate(worth) if w > max(worth) - 1e-9)
    while last + 1 < len(cuts) and worth[last + 1] > max(worth) - 1e-9:
        last += 1
    k = sum(w >= (cuts[first] + cuts[last]) / 2 for w in weight.values())
    ranked = sorted(weight, key=lambda i: 4 * weight[i] - math.log(-math.log(uniform[i])), reverse=True)
    return {i: (weight[i], i in set(ranked[:k])) for i in weight}


def test_resampling_equals_brute_force(spark):
    rng = random.Random(11)
    words, junk = [f"word{i}é" for i in range(60)], ["zzkq", "QQ!!", "buy"]
    rows, good, bad = [], [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if spoiled := rng.random() < 0.35:
            text += rng.sample(junk, rng.randint(1, 3)) * rng.randint(1, 3)
            rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 3:
            (bad if spoiled else good).append(i)
    rows += [(600, None), (601, ""), (602, "buy " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, k % 2, k % 2) for k, i in enumerate(bad)], "doc_id long, quality int, toxic int")
    draws = docs.select("doc_id", F.pmod(F.xxhash64(F.lit(quality.SEED), "doc_id"), F.lit(1 << 52)).alias("u"))
    want = brute_resample(rows, good, bad, {r.doc_id: (r.u + 0.5) / 2**52 for r in draws.collect()})
    got = {r.doc_id: r.log_weight for r in quality.resample(docs, labels).collect()}
    assert set(got) == {i for i, (_, kept) in want.items() if kept} and 100 < len(got) < 500
    assert [got[i] for i in sorted(got)] == pytest.approx([want[i][0] for i in sorted(got)], rel=1e-4, abs=1e-4)
    assert any(w < 0 for w, _ in want.values())
