"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, shared, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keep_id string")
    got = exact_dedup.name_documents(docs, **options).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[norm(r.row.text)]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.text_sha256) == (keep, len(ids), hashlib.sha256(norm(r.row.text).encode()).hexdigest())
        assert not r.kept or r.doc_id == keep
    assert sum(r.kept for r in got) == len(groups)
    assert len({(r.n_blocks, r.name) for r in got}) == len(groups)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "a b"), (6, "a\x0b \r\nb"), (6, "a b"), (None, "a b"), (None, "only null"), (7, " a b"),
    (8, "abcd" * 9), (9, "abcd" * 9), (10, "abcd" * 8 + "abce"), (11, "abcd" * 17 + "é"), (12, "abcd" * 17 + "é"), (13, "abcdabcd"), (14, "abcd"), (15, "a\xa0b"),
]


def test_block_naming(spark):
    check_exact(spark, EDGES, block_bytes=4)
    assert exact_dedup.name_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_block_naming_with_colliding_hashes(spark):
    random.seed(5)
    rows = [(i, "".join(random.choice("ab ") for _ in range(random.randint(0, 14)))) for i in range(150)]
    check_exact(spark, rows, block_bytes=2, hash_bits=1)


def test_keep_first_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x", "r", 2), (0, "x", "s", 3), (0, "x", "s", 3)], "doc_id long, text string, row string, rid long")
    assert [tuple(r) for r in exact_dedup.keep_first(docs).collect()] == [(0, "x", "s", 3)]


def brute_fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    codes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(ids, fps):
    label = list(range(len(ids)))
    for _ in ids:
        for a in range(len(ids)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    return {i: min((ids[k] for k in range(len(ids)) if label[k] == label[n] and ids[k] is not None), default=None) for n, i in enumerate(ids)}


def test_simhash(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "É a b c"), (906, "é a b c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    for (i, _), fp in zip(rows, fps):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", want[i])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_linked_within_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    near = np.unique([b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 16, (40, 2))]).astype(np.uint64)
    a, b = simhash.linked_within(near, simhash.references())
    want = {(i, j) for i in range(len(near)) for j in range(i) if int(near[i] ^ near[j]).bit_count() <= 2}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_fingerprint_links_connect_chains(spark):
    rng = random.Random(4)
    fps = [0]
    for _ in range(60):
        fps.append(fps[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted({int(np.array(f, np.uint64).view(np.int64)) for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    tree = shared.connected_components(simhash.fingerprint_links(df)).collect()
    assert len(tree) == len(signed) and {r.component for r in tree} == {min(signed)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = shared.connected_components(edges.unionByName(spark.createDataFrame([(500, 501), (7, 7)], "u long, v long"))).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def brute_removed(rows, window=50):
    words = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def check_repeats(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = substring_dedup.remove_repeats(docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_removed(rows)
    return got


def test_repeated_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 130))] for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts += p[a : len(p) - rng.randrange(0, 20)] if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 70))]
        rows.append((i, (" " if i % 2 else "\n\t").join(parts)))
    rows += [(200, "same " * 120), (201, "same " * 60), (201, "same " * 60), (None, "same " * 70), (202, None), (203, ""), (3, rows[3][1]), (204, " ".join(passages[0]))]
    got = check_repeats(spark, rows).where("n_removed > 0").collect()
    for r in got:
        assert all(f.n_words >= 50 and f.source_id < r.doc_id for f in r.factors)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_boundaries(spark):
    a, b = [f"a{k}" for k in range(80)], [f"b{k}" for k in range(80)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[40:] + b[:40])), (4, " ".join(a[31:] + b[:49])), (5, " ".join(a[20:70])), (6, " ".join(a[20:69])), (7, " ".join(a[60:] + b[:30]))]
    check_repeats(spark, rows)
