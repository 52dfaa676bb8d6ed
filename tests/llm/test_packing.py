"""Packing against sequential best fit, and placements that must hold."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = "ab the  \n\t é😀ß thing12.,'s  中文\x1c 　 "


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def sequential(lengths, capacity):
    """Best fit one piece after another: the number of sequences and the sorted fillings."""
    gaps, held = [], {}
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - length)
    return len(gaps), sorted(gaps)


def holds(rows, capacity):
    """Each sequence is filled from 0 on without gaps, within capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(n for _, n in parts) for parts in by.values())


def test_words_give_the_librarys_ids(library):
    random.seed(5)
    encoder = packing.WordEncoder(packing.read_model(MODEL))
    texts = ["".join(random.choice(AWKWARD) for _ in range(random.randint(0, 30))) for _ in range(800)]
    texts += ["", " ", "a  b", "a <|endoftext|> b", "x<|endoftext|>", " a", "a ", "a \n b", "it's we'll 's"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.ids(texts) == want
    assert encoder.ids(texts[::-1]) == want[::-1]


def test_latin_words_by_merging_give_the_librarys_ids(library):
    random.seed(6)
    merge = packing.merger(packing.read_model(MODEL)).encode_ordinary
    signs = [chr(c) for c in range(1, ord(packing.LATIN_END))]
    words = ["".join(random.choice(signs) for _ in range(random.randint(1, 25))) for _ in range(4000)]
    words += ["".join(random.choice("aeiourstlnmdh0123'") for _ in range(random.randint(1, 25))) for _ in range(20000)]
    for w, e in zip(words, library.encode_batch_fast([" " + w for w in words], add_special_tokens=False)):
        if "<|endoftext|>" not in w:
            assert merge(" " + w) == e.ids, w
    assert packing.merger(packing.read_model(public_tokenizers.path("word_bpe_49k.json"))) is None


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_moves_are_best_fit(capacity):
    random.seed(capacity)
    for _ in range(40):
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 400))]
        if random.random() < 0.5:
            lengths += [max(1, capacity // 3)] * random.randint(0, 300)
        moves = packing.best_fit(Counter(lengths), capacity)
        ranked = sorted(lengths, reverse=True)
        used = Counter()
        placed = []
        for k, (rank, sequence, each, offset, length) in enumerate(moves):
            upto = moves[k + 1][0] if k + 1 < len(moves) else len(ranked)
            for j in range(upto - rank):
                assert ranked[rank + j] == length
                placed.append((sequence + j // each, offset + j % each * length, length))
        for sequence, offset, length in sorted(placed):
            assert used[sequence] == offset
            used[sequence] += length
        n, gaps = sequential(lengths, capacity)
        assert len(placed) == len(ranked) and len(used) == n
        assert sorted(capacity - x for x in used.values()) == gaps


def test_pack_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, MODEL, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    lengths = []
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in by[d.doc_id])
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        assert got == want
        lengths += [w[2] for w in want]
    assert holds(rows, 1024) == sequential(lengths, 1024)[1]


def test_sequences_hold_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    placed = packing.place(packing.pieces(docs, MODEL, capacity=128, with_ids=True), 128)
    packed = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert packed[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    assert all(len(p.ids) == sum(p.lengths) <= 128 for p in packed.values())


def test_pack_edges(spark, library):
    rows = [(1, None, 5), (1, "", 6), (None, "a b", 7), (2, "word " * 3000, 8), (3, "same text", 9), (3, "same text", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").withColumn("rank", F.lit("x")).withColumn("row", F.lit(1))
    got = packing.pack(docs, MODEL).collect()
    n = len(library.encode("word " * 3000, add_special_tokens=False).ids) + 1
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1, 2: -(-n // 1024), 3: 2}
    assert [r.length for r in got if r.doc_id == 1] == [1, 1]
    assert sum(r.length for r in got if r.doc_id == 2) == n
    holds(got, 1024)
    assert packing.pack(docs.where("false"), MODEL).count() == 0


def test_place_keeps_other_columns_and_many_equal_lengths(spark):
    parts = spark.range(20_000).select(F.lit(300).alias("length"), F.col("id").alias("rank"), F.lit("t").alias("tie"))
    got = packing.place(parts).collect()
    assert len(got) == 20_000 and {r.rank for r in got} == set(range(20_000))
    assert len({r.sequence_id for r in got}) == -(-20_000 // 3)
    holds(got, 1024)
    with pytest.raises(ValueError):
        packing.place(parts.withColumn("length", F.lit(2000)))
