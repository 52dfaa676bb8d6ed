"""The near-dedup stage takes its first links from the fingerprints of op3."""

from linkloom.llm import near_copies
from linkloom.runtime import _written


def test_first_pairs_are_those_of_linked_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words + ["end"]), " ".join(words).upper(), " ".join(f"other{i}" for i in range(60))]
    rounds, possible = [], near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda pairs, parities: rounds.append({(r.u, r.v) for r in pairs.collect()}) or possible(pairs, parities))
    rows = near_copies.materialize(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"))
    got = {(r.node, r.component) for r in near_copies.connected_components(near_copies.links(rows)).collect()}
    assert got == {(0, 0), (1, 0), (2, 0)}
    assert (2, 0) in rounds[0] and all(3 not in pair for pair in rounds[0])


def test_a_fingerprint_link_is_judged_by_the_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "fingerprint_of", lambda codes: 0)
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.keep_one(rows).count() == 3


def test_the_stage_leaves_two_tables(spark):
    rows = spark.createDataFrame([(i, f"text {i // 2}") for i in range(8)], "doc_id long, text string")
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    kept = near_copies.keep_one(rows)
    assert len(own) == before + 2 and kept.count() == 4
