"""Alignment of two tokenizers' ids, with a fast path for tokens of the same bytes.

Both encodings of a text are cut where both have a token end; every token of the one and every token
of the other in such a group are linked, and a pair of ids counts the documents that hold it.  Most
groups are one token and one token with the same bytes.  The id that stands for a token's bytes in the
other vocabulary is known beforehand, so these pairs need no key but the first id: a task counts them
in a vector as long as the vocabulary.  Only the pairs of the other groups are shuffled.

The counts come back the same way: vectors of vocabulary length and a bounded table of the most
frequent other pairs travel to the tasks, and what is in neither is joined by pair.  Pairs that many
documents share are in the table, so the join has no hot key.

Both tokenizers cut before a single blank that a word follows; words are therefore aligned once and
remembered by the task.  Texts with other white space beside a blank are aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import byte_of_sign, text_groups
from linkloom.llm.token_counts import read_model
from linkloom.runtime import materialize

BLANK = "▁"
#: Words a task remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 300_000
#: Irregular pairs that travel to the tasks, at most; rarer ones are joined.
FREQUENT = 1 << 18
_LOOSE = re.compile(r"^ | (?:\s|$)")
_PART = 1 << 20  # pairs of one group that are listed at a time


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and for each first id the second id with the same bytes."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(piece_model)
        signs = byte_of_sign()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in json.loads(byte_model)["model"]["vocab"].items():
            self.bytes_a[i] = bytes(map(signs.__getitem__, token))
        n = self.b.GetPieceSize()
        single = [self.b.IsByte(i) for i in range(n)]
        unread = [self.b.IsControl(i) or self.b.IsUnknown(i) for i in range(n)]
        pieces = [self.b.IdToPiece(i) for i in range(n)]
        self.bytes_b = [
            b"" if skip else bytes([int(p[3:5], 16)]) if byte else p.replace(BLANK, " ").encode()
            for p, byte, skip in zip(pieces, single, unread)
        ]
        of_bytes = {x: i for i, x in enumerate(self.bytes_b) if x and single[i]}
        of_bytes |= {x: i for i, x in enumerate(self.bytes_b) if x and not single[i]}
        self.same = np.array([of_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = len(self.bytes_a), n
        self.length_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.length_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.text_a = [f"{i}{c}".encode() for c in ",|" for i in range(self.size_a)]
        self.text_b = [f"{i}{c}".encode() for c in ",;" for i in range(self.size_b)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each text, by each tokenizer."""
        if not texts:
            return [], []
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode("utf-8", "surrogatepass")
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))


@dataclass
class Ragged:
    """Lists of numbers, one after another."""

    sizes: np.ndarray
    values: np.ndarray

    @classmethod
    def empty(cls) -> Ragged:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def plus(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.sizes, other.sizes]), np.concatenate([self.values, other.values]))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, value) of each number of the lists ``at``."""
        sizes = self.sizes[at]
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        owner = np.repeat(np.arange(len(at)), sizes)
        return owner, self.values[np.arange(len(owner)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]


def _of(owner: np.ndarray, value: np.ndarray, n: int) -> Ragged:
    order = np.argsort(owner, kind="stable")
    return Ragged(np.bincount(owner, minlength=n), value[order])


def _listed(owner: np.ndarray, value: np.ndarray, times: np.ndarray, n: int, span: int) -> tuple[Ragged, np.ndarray]:
    """The different values of each owner, ascending, and how often each occurs."""
    key, back = np.unique(owner * span + value, return_inverse=True)
    total = np.bincount(back, times, len(key)).astype(np.int64)
    return Ragged(np.bincount(key // span, minlength=n), key % span), total


class Aligned:
    """What is known of a list of texts; ``take`` puts it together for documents."""

    def __init__(self, v: Vocabularies, texts: list[str] = (), ids: tuple | None = None):
        a, b = v.encode(texts) if ids is None else ids
        n = len(a)
        self.n_a, self.n_b = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
        flat_a, flat_b = (np.fromiter((i for x in y for i in x), np.int64) for y in (a, b))
        text_a, text_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        end_a, end_b = np.cumsum(v.length_a[flat_a]), np.cumsum(v.length_b[flat_b])
        common = np.zeros((end_a[-1] if len(end_a) else 0) + 1, np.int64)
        common[end_b] = 1
        last_a = common[end_a].astype(bool)
        group_a = np.cumsum(last_a) - last_a
        common[:] = 0
        common[end_a] = 1
        last_b = common[end_b].astype(bool)
        group_b = np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        self.group_text = text_a[last_a]
        self.n_groups = np.bincount(self.group_text, minlength=n)
        self.n_links = np.bincount(self.group_text, in_a * in_b, n).astype(np.int64)
        plain = (in_a == 1) & (in_b == 1)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        one = np.flatnonzero(plain)
        x, y = flat_a[first_a[one]], flat_b[first_b[one]]
        own = v.same[x] == y
        self.identity = _of(self.group_text[one][own], x[own], n)
        # the others: every pair of a group, a bounded number at a time
        size = v.size_b
        keys, times, owners = [x[~own] * size + y[~own]], [np.ones(int((~own).sum()), np.int64)], [self.group_text[one][~own]]
        odd = np.flatnonzero(~plain)
        small = odd[(in_a * in_b)[odd] <= _PART]
        for lo, hi in _runs(np.cumsum((in_a * in_b)[small])):
            part = small[lo:hi]
            each = in_b[part]
            ga, a_at = _spread(first_a[part], in_a[part])
            _, b_at = _spread(first_b[part][ga], each[ga])
            a_id = np.repeat(flat_a[a_at], each[ga])
            keys.append(a_id * size + flat_b[b_at])
            times.append(np.ones(len(a_id), np.int64))
            owners.append(np.repeat(self.group_text[part][ga], each[ga]))
        for g in odd[(in_a * in_b)[odd] > _PART].tolist():
            ua, ta = np.unique(flat_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ub, tb = np.unique(flat_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append((ua[:, None] * size + ub[None, :]).ravel())
            times.append((ta[:, None] * tb[None, :]).ravel())
            owners.append(np.full(len(keys[-1]), self.group_text[g]))
        self.pairs, self.pair_times = _listed(*(np.concatenate(z) for z in (owners, keys, times)), n, v.size_a * size)
        self.texts = self._written(v, flat_a, flat_b, group_a, group_b, last_a, last_b)

    def _written(self, v, flat_a, flat_b, group_a, group_b, last_a, last_b) -> list[bytes]:
        """The groups of each text as written for the digest, with a sign after each group."""
        written = np.empty(len(flat_a) + len(flat_b), object)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(flat_b)) + np.cumsum(in_a)[group_b]
        written[at_a] = list(map(v.text_a.__getitem__, (flat_a + v.size_a * last_a).tolist()))
        written[at_b] = list(map(v.text_b.__getitem__, (flat_b + v.size_b * last_b).tolist()))
        listed, out, at = written.tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(listed[at : at + n]))
            at += n
        return out

    def plus(self, other: Aligned) -> None:
        for name in ("n_a", "n_b", "n_groups", "n_links", "pair_times"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.identity, self.pairs = self.identity.plus(other.identity), self.pairs.plus(other.pairs)
        self.texts += other.texts


def _spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, position) of each position in runs that begin at ``first``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _runs(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs that hold about ``_PART`` each, by the running total."""
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PART, side="right")))
        yield lo, hi
        lo = hi


class Aligner:
    """Alignment of documents, word by word where that gives the same."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        self.v = Vocabularies(byte_model, piece_model)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words = Aligned(self.v)

    def _cut(self, texts: list[str]) -> list[list[str] | None]:
        return [None if not t or BLANK in t or _LOOSE.search(t) else t.split(" ") for t in texts]

    def _learn(self, cut: list[list[str] | None]) -> set[str]:
        """Align words not met before; the words whose bytes do not come back."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list({w for c in cut if c for w in c if w not in self.known})
        a, b = self.v.encode(new)
        good = [self.v.same_bytes(w, x, y) for w, x, y in zip(new, a, b)]
        kept = [i for i, ok in enumerate(good) if ok]
        self.known.update(zip((new[i] for i in kept), range(len(self.known), len(self.known) + len(kept))))
        self.words.plus(Aligned(self.v, ids=([a[i] for i in kept], [b[i] for i in kept])))
        return {w for w, ok in zip(new, good) if not ok}

    def align(self, texts: list[str]) -> dict:
        """Columns of the documents ``texts``."""
        cut = self._cut(texts)
        bad = self._learn(cut)
        if bad:
            cut = [c if c and bad.isdisjoint(c) else None for c in cut]
        whole = [i for i, c in enumerate(cut) if c is None and texts[i]]
        a, b = self.v.encode([texts[i] for i in whole])
        whole_ok = [k for k, i in enumerate(whole) if self.v.same_bytes(texts[i], a[k], b[k])]
        rest = Aligned(self.v, ids=([a[k] for k in whole_ok], [b[k] for k in whole_ok]))
        n, by_words = len(texts), [i for i, c in enumerate(cut) if c]
        parts = [(self.words, np.repeat(by_words, [len(cut[i]) for i in by_words]).astype(np.int64), np.fromiter((self.known[w] for i in by_words for w in cut[i]), np.int64))]
        parts.append((rest, np.array([whole[k] for k in whole_ok], np.int64), np.arange(len(whole_ok))))
        out = {
            name: sum(np.bincount(doc, getattr(x, name)[at], n) for x, doc, at in parts).astype(np.int64)
            for name in ("n_a", "n_b", "n_groups", "n_links")
        }
        ids, keys = [], []
        for x, doc, at in parts:
            owner, value = x.identity.take(at)
            ids.append((doc[owner], value, np.ones(len(value), np.int64)))
            owner, key = x.pairs.take(at)
            times = Ragged(x.pairs.sizes, x.pair_times).take(at)[1]
            first, second = np.divmod(key, self.v.size_b)
            own = self.v.same[first] == second  # an identity pair of another group
            ids.append((doc[owner][own], first[own], times[own]))
            keys.append((doc[owner][~own], key[~own], times[~own]))
        join = lambda z: [np.concatenate(c) for c in zip(*z)]
        out["ids"], out["id_times"] = _listed(*join(ids), n, self.v.size_a)
        out["keys"], out["key_times"] = _listed(*join(keys), n, self.v.size_a * self.v.size_b)
        written = [b""] * n
        known = self.words.texts
        for i in by_words:
            written[i] = b"".join([known[k] for k in map(self.known.__getitem__, cut[i])])
        for k, i in zip(range(len(whole_ok)), parts[1][1].tolist()):
            written[i] = rest.texts[k]
        out["groups"] = [w[:-1] for w in written]
        return out


def _list_array(lists: Ragged, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lists.sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


_COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_LISTS = "ids array<int>, id_times array<int>, keys array<long>, key_times array<int>"


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per document its counts, the digest of its groups and its different pairs with their numbers of links.

    Identity pairs are ``ids`` (first ids), the others ``keys`` (first id times the size of the second
    vocabulary, plus second id).  ``with_groups`` adds ``groups``, the groups themselves as text.
    """
    models = read_model(byte_path), read_model(piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*models)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for group in text_groups(texts):
                got = aligner.align([texts[i] for i in group])
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                columns = [batch.column(0).slice(group[0], len(group)), *[pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string())]
                columns += [_list_array(got[c], x, kind) for c, x, kind in (("ids", got["ids"].values, pa.int32()), ("ids", got["id_times"], pa.int32()), ("keys", got["keys"].values, pa.int64()), ("keys", got["key_times"], pa.int32()))]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "id_times", "keys", "key_times"]
                if with_groups:
                    columns.append(pa.array([g.decode() for g in got["groups"]], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(run, f"{_COUNTED}, {_LISTS}" + ", groups string" * with_groups)


def _vector(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    return count


def _filled(rows: DataFrame, size: int) -> np.ndarray:
    """A vector from rows ``(a, n)``, one for each id at most."""
    got, out = rows.toArrow(), np.zeros(size, np.int64)
    out[got.column("a").to_numpy()] = got.column("n").to_numpy()
    return out


@dataclass(frozen=True)
class PairCounts:
    """In how many documents each pair is linked."""

    same: np.ndarray  # second id with the bytes of each first id, or -1
    identity: np.ndarray  # count of each first id's identity pair
    best: np.ndarray  # highest count of each first id
    others: DataFrame  # (key, n): the other pairs
    size_b: int

    def table(self) -> DataFrame:
        """All pairs as rows ``(a_id, b_id, n, is_best)``."""
        spark = self.others.sparkSession
        at = np.flatnonzero(self.identity)
        own = spark.createDataFrame(pa.table({"a_id": at, "b_id": self.same[at], "n": self.identity[at], "is_best": self.identity[at] == self.best[at]}))
        a = (F.col("key") / self.size_b).cast("long")
        top = spark.createDataFrame(pa.table({"a_id": np.arange(len(self.best)), "top": self.best}))
        rest = self.others.select(a.alias("a_id"), (F.col("key") % self.size_b).alias("b_id"), "n")
        return own.unionByName(rest.join(top, "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("is_best")))


def pair_counts(lists: DataFrame, byte_path: str, piece_path: str) -> PairCounts:
    """Counts over the written table ``lists`` of ``aligned``; the driver sees vectors of vocabulary length."""
    v = Vocabularies(read_model(byte_path), read_model(piece_path))
    rows = lists.select("ids").mapInArrow(_vector(v.size_a), "a long, n long")
    identity = _filled(rows.groupBy("a").agg(F.sum("n").alias("n")), v.size_a)
    others = materialize(lists.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    a = F.floor(F.col("key") / v.size_b).cast("long")
    best = np.maximum(identity, _filled(others.groupBy(a.alias("a")).agg(F.max("n").alias("n")), v.size_a))
    return PairCounts(v.same, identity, best, others, v.size_b)


def _frequent(others: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of all pairs with at least the returned count, ``most`` at most."""
    sizes = others.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 0, sum(r["n"] for r in sizes)
    for power, n in sorted((r["power"], r["n"]) for r in sizes):
        if held <= most:
            break
        held, least = held - n, 2 ** (power + 1)
    got = others.where(F.col("n") >= least).toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order], least


def _scored(counts: PairCounts, key: np.ndarray, n: np.ndarray):
    identity, best, size_b = counts.identity, counts.best, counts.size_b

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sizes = [np.diff(batch.column(c).offsets.to_numpy()) for c in (1, 3)]
            ids, id_times, keys, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2, 3, 4))
            owner = np.repeat(np.arange(rows), sizes[0])
            total = _sums(owner, identity[ids] * id_times, rows)
            top = _sums(owner, (identity[ids] == best[ids]) * id_times, rows)
            owner = np.repeat(np.arange(rows), sizes[1])
            at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            hit = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            count = np.where(hit, n[at], 0) if len(key) else np.zeros(len(keys), np.int64)
            total += _sums(owner, count * times, rows)
            top += _sums(owner, (hit & (count == best[keys // size_b])) * times, rows)
            left = Ragged(np.bincount(owner[~hit], minlength=rows), keys[~hit])
            columns = [batch.column(0), pa.array(top), pa.array(total), _list_array(left, left.values, pa.int64()), _list_array(left, times[~hit], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n_best", "count_sum", "keys", "key_times"])

    return score


def _sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by owner, the owners ascending."""
    total = np.concatenate([[0], np.cumsum(value)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The first tokenizer encodes a blank and the text, the second the text; strings of special tokens
    are plain text.  Null and empty texts, and texts that the tokens' bytes do not give back, have no
    tokens and an empty digest.  Rows that share an id, and null ids, keep their rows and count as
    documents of their own; an empty table gives an empty result; other columns are not read.  Both
    model files are read on the driver and travel with the job.
    """
    lists = materialize(aligned(docs, byte_path, piece_path, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    counts = pair_counts(lists, byte_path, piece_path)
    key, n, least = _frequent(counts.others, frequent)
    arrays = lists.select("rid", "ids", "id_times", "keys", "key_times")
    scored = materialize(arrays.mapInArrow(_scored(counts, key, n), "rid long, n_best long, count_sum long, keys array<long>, key_times array<int>"))
    rare = scored.select("rid", F.explode(F.arrays_zip("keys", "key_times")).alias("p")).select("rid", "p.*")
    top = scored.sparkSession.createDataFrame(pa.table({"a": np.arange(len(counts.best)), "top": counts.best}))
    counted = (
        counts.others.where(F.col("n") < least)
        .withColumn("a", F.floor(F.col("key") / counts.size_b).cast("long"))
        .join(F.broadcast(top), "a")
        .select(F.col("key").alias("keys"), "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    )
    added = rare.join(counted, "keys").groupBy("rid").agg(
        F.sum(F.col("n") * F.col("key_times")).alias("more"), F.sum(F.col("is_best") * F.col("key_times")).alias("more_best")
    )
    whole = lists.drop("ids", "id_times", "keys", "key_times").join(scored.select("rid", "n_best", "count_sum"), "rid").join(added, "rid", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
