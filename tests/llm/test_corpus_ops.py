"""Decontamination, quality, mixing, the pipeline and the registered queries."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import decontaminate, mixing, quality, queries


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, item in items:
            w = decontaminate.words_of(item)
            halves = [h for h in (w[: len(w) // 2], w[len(w) // 2 :]) if h]
            if w and i is not None and all(decontaminate.overlaps([decontaminate.shingles(h)], words) >= 0.8 for h in halves):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(1)
    for k, (i, text) in enumerate(items[:20]):
        around = docs[k][1][:300]
        docs += [(9000 + k, f"{around}\n{text.upper()}\n{around}"), (9100 + k, around + " " + " ".join(text.split()[: len(text.split()) // 2])), (9200 + k, rng.choice(["", text[::-1]]))]
    docs += [(1, None), (9300, items[0][1] + " " + "filler " * 5000 + items[1][1]), (9300, items[0][1])]
    items += [(None, "a b c"), (800, None), (801, ""), (802, "..."), (803, "unseen words only here"), (804, items[0][1]), (0, items[0][1])]
    table = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table, bench)
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (9000, 0) in want and (9100, 0) not in want
    clean = decontaminate.drop_leaked(table, bench)
    assert clean.columns == table.columns
    leaky = {(d, t) for d, t in docs if brute_leaks([(d, t)], items)}
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(x) for x in docs if x not in leaky)
    assert decontaminate.leaks(table.limit(0), bench).count() == decontaminate.leaks(table, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaked(table, bench.limit(0)).count() == len(docs)


def test_several_indexes_find_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 15)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == whole


def labelled_corpus(n=2400):
    rng = random.Random(7)
    common = ["the", "of", "and", "river", "stone", "cloud", "light", "field", "paper", "water"]
    rows, labels, bad = [], [], set()
    for i in range(n):
        words = [rng.choice(common) + rng.choice(["", "", "s"]) for _ in range(rng.randint(1, 120))]
        kind = rng.random()
        if kind < 0.12:
            words.insert(rng.randrange(len(words) + 1), "horrid")
        elif kind < 0.2:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.25:
            words = [rng.choice(common)] * 30
        if kind < 0.25:
            bad.add(i)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(kind >= 0.25 or kind < 0.12), int(kind < 0.12)))
    return rows, labels, bad


def test_resampling_on_held_out_documents(spark):
    rows, labels, bad = labelled_corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, good double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.resample(docs, table)
    assert kept.columns == [*docs.columns, "log_weight", "gumbel_key"]
    ids = {r.doc_id for r in kept.collect()}
    held_out = [i for i, _ in rows if i % 2]
    assert sum(i in ids for i in held_out if i in bad) <= 0.05 * sum(i in bad for i in held_out)
    assert sum(i in ids for i in held_out if i not in bad) >= 0.98 * sum(i not in bad for i in held_out)
    assert ids == {r.doc_id for r in quality.resample(docs.repartition(3), table).collect()}


def test_resampling_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == len(rows)
    assert quality.resample(docs, labels.limit(0)).count() == len(rows)
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [50.0, -70.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ranked = np.sort(values)[::-1]
    for k in (1, 2, 1000, 1300, 1500, len(values)):
        assert quality.kth_largest(df, "x", k, few=50) == ranked[k - 1]


def brute_targets(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    fixed, left = {}, 1.5 * sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        over = [i for i in rest if left * w[i] / sum(w[j] for j in rest) > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, left * w[i] / max(1, sum(w[j] for j in rest))) for i in range(len(sizes))]
        for i in over:
            fixed[i] = 2.0 * sizes[i]
        left = 1.5 * sum(sizes) - sum(fixed.values())


def test_targets():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 30):
        sizes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(n)]
        assert mixing.targets(sizes) == pytest.approx(brute_targets(sizes))
    assert mixing.targets([]) == []


def test_large_draws_have_the_exact_distribution():
    """Against exact probabilities: a small urn summed in the same way, and moments of a large one."""
    from math import comb

    class Fixed:
        def __init__(self, u):
            self.u = u

        def random(self):
            return self.u

    n, others, take = 700_000_000, 800_000_000, 5
    exact = [comb(n, x) * comb(others, take - x) / comb(n + others, take) for x in range(take + 1)]
    bounds = np.concatenate([[0], np.cumsum(exact)])
    for x in range(take + 1):
        for u in (bounds[x] + 1e-7, bounds[x + 1] - 1e-7):
            assert mixing._drawn(n, others, take, Fixed(u)) == x
    rng = np.random.default_rng(1)
    n, others, take = 3 * 10**9, 10**9, 10**9
    got = np.array([mixing._drawn(n, others, take, rng) for _ in range(400)], float)
    spread = (take * 0.75 * 0.25 * 0.75) ** 0.5
    assert abs(got.mean() - 0.75 * take) < 5 * spread / 20 and 0.85 < got.std() / spread < 1.15


def test_mix_does_not_depend_on_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    one, other = (sorted(map(str, mixing.mix(d).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == other


def test_the_tree_decides_the_shards(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.shards for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed: np.array([[q] + [0] * (shards - 1) for q in quotas]))
    after = {r.doc_id: r.shards for r in mixing.mix(docs).collect()}
    assert before != after and all(s in (None, [0]) for s in after.values())


def test_splitting_tree_meets_all_quotas():
    for quotas in ([5, 0, 7], [1], [0, 0], [1000, 3, 17, 10**9, 4 * 10**9]):
        shares = mixing.splitting_tree(quotas, 7)
        assert shares.min() >= 0 and shares.sum(1).tolist() == quotas
        assert shares.sum(0).max() - shares.sum(0).min() <= 1


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("x"))
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
    names = sorted(by)
    want = dict(zip(names, brute_targets([sum(by[s]) for s in names])))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sum(by[s]) and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == docs.count() and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "d " * 3000, None), (4, "e f", "\U0001F600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {r.target for r in got if r.size == 0 and r.source_size == 0} == {0.0}
    assert sum(r.taken for r in got) == pytest.approx(1.5 * 3008, abs=4)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_drawn_blocks_are_disjoint_and_even(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = mixing.sized_documents(docs)
    blocks = mixing.drawn_blocks(sized, mixing.plan_sources(sized), shards=5, block_words=64).collect()
    assert len({(r.rid, r.copy, r.first_word) for r in blocks}) == len(blocks)
    shards = defaultdict(int)
    for r in blocks:
        shards[r.shard] += 1
    assert set(shards) == set(range(5)) and max(shards.values()) - min(shards.values()) <= 1


def test_write_shards(spark, tmp_path):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i)), "s%d" % (i % 2)) for i in range(40)]
    rows += [(5, "same id other words", "s1"), (None, "no id", "s0"), (None, None, "s0"), (None, "no other id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.write_shards(docs, str(tmp_path / "mix"), shards=3)
    words, want = defaultdict(int), defaultdict(int)
    for r in spark.read.parquet(str(tmp_path / "mix")).collect():
        words[r.doc_id] += len(r.text.split())
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert dict(words) == {d: n for d, n in want.items() if n}
    assert len(list((tmp_path / "mix" / "shard=0").glob("*.parquet"))) > 1


def test_halves_apart_and_scores_that_do_not_depend_on_slices(spark, sf, monkeypatch):
    """A plain scorer over whole documents; the item's halves lie up to many passages apart."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    longest = max(items, key=lambda r: len(decontaminate.words_of(r[1])))
    docs, rng = [], random.Random(3)
    for k, gap in enumerate((0, 7, 30, 90, 400)):
        for start in range(0, 130, 13):
            w = longest[1].split()
            filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
            docs.append((100 * k + start, " ".join([filler(start), *w[: len(w) // 2], filler(gap), *w[len(w) // 2 :], filler(50)])))
    docs += [(900, items[3][1]), (901, "x " * 70 + items[4][1] + " and " + items[5][1])]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.leaks(table, bench).collect()))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert found == brute_leaks(docs, items) and {(d, longest[0]) for d, _ in docs[:50]} <= found
    for r in decontaminate.leaks(table, bench).where("doc_id >= 900").collect():
        assert r.score > 0.99 and r.overlap == 1.0  # the passage holds the item, so its own score
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 15)
    assert sorted(map(str, decontaminate.leaks(table, bench).collect())) == whole


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        before = {r.doc_id for r in docs.collect()}
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        after = {r.doc_id for r in kept.collect()}
        assert after <= before and after
        docs = kept
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=30)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)
