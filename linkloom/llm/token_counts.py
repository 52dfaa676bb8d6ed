"""Exact token counts at every prefix of a text, by dynamic programming over the vocabulary.

In byte-pair encoding the encoding of a prefix ends in one token, and that token is the only piece
``t`` at the prefix's end for which the encoding of what is before ``t`` ends in a token that keeps
its border with ``t``: the pair, encoded alone, stays the same two tokens.  So the last token and
the count of every prefix follow from those of shorter prefixes, and a text is never encoded.
Border tests are remembered by pair.

No piece has a blank after another character, and characters outside the vocabulary become bytes
that join nothing.  Text is therefore cut before blanks and at line ends, the table of a chunk is
computed once per chunk and task, and the table of a text is the running sum of its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
BLANK = "▁"
BATCH_CHARS = 1 << 21
#: Chunks and pairs a task remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 400_000
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


class PrefixTable:
    """Prefix counts under one sentencepiece byte-pair model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.name != "identity" or not spec.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback and without text normalisation is expected")
        if spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model that keeps blanks and puts one before the text is expected")
        spec.normalizer_spec.add_dummy_prefix = False
        self.encoder = sentencepiece.SentencePieceProcessor()
        self.encoder.LoadFromSerializedProto(spec.SerializeToString())
        self.pieces = [p.piece for p in spec.pieces]
        normal = [(p.piece, i) for i, p in enumerate(spec.pieces) if p.type == 1]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p, _ in normal):
            raise ValueError("a piece runs across a blank or a line end")
        self.size = len(self.pieces)
        self.start, self.byte = self.size, self.size + 1
        self._build(normal)
        self.borders: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def _build(self, normal: list[tuple[str, int]]) -> None:
        alphabet = sorted({ord(c) for p, _ in normal for c in p})
        self.alphabet = np.array(alphabet, np.uint32)
        code = {c: i for i, c in enumerate(alphabet)}
        width, child, token = len(alphabet), {}, [-1]
        for piece, i in normal:
            node = 0
            for c in piece:
                key = node * width + code[ord(c)]
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                node = child[key]
            token[node] = i
        self.edges = np.array(sorted(child), np.int64)
        self.children = np.array([child[k] for k in self.edges.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.roots = self._step(np.zeros(width, np.int64), np.arange(width))

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node * len(self.alphabet) + char
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((self.edges[at] == key) & (char >= 0), self.children[at], -1)

    def _kept(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the border between the two tokens stays when they are encoded together."""
        pairs, back = np.unique(before * (self.size + 2) + token, return_inverse=True)
        listed = pairs.tolist()
        known = self.borders
        new = [p for p in listed if p not in known]
        if new:
            if len(known) + len(new) > 2 * REMEMBERED:
                known.clear()
                new = listed
            left, right = np.divmod(np.array(new), self.size + 2)
            texts = [
                (self.pieces[a] if a < self.size else "") + self.pieces[b] for a, b in zip(left.tolist(), right.tolist())
            ]
            for p, a, b, got in zip(new, left.tolist(), right.tolist(), self.encoder.encode(texts, num_threads=1)):
                known[p] = got == ([a, b] if a < self.size else [b])
        return np.fromiter((known[p] for p in listed), bool, len(listed))[back]

    def prefix_counts(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes, the empty one included, chunk after chunk, and where each begins."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        limit = ends[owner]
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        chars = np.where(self.alphabet[at] == points, at, -1)
        first = np.arange(len(points))
        unknown = first[chars < 0]
        found = [(unknown, unknown + 1, np.full(len(unknown), self.byte))]
        where, node, depth = first, np.where(chars >= 0, self.roots[chars], -1), 0
        while True:
            where, node = where[node >= 0], node[node >= 0]
            if not len(where):
                break
            depth += 1
            token = self.token[node]
            hit = token >= 0
            found.append((where[hit], where[hit] + depth, token[hit]))
            inside = where + depth < limit[where]
            where, node = where[inside], node[inside]
            node = self._step(node, chars[where + depth])
        begin, end, token = (np.concatenate(x) for x in zip(*found))
        shift = owner[begin]  # the table has one entry more than characters in each chunk
        length = end - (ends - sizes)[shift]
        short = length.max(initial=0) < 1 << 16
        order = np.argsort(length.astype(np.uint16) if short else length, kind="stable")  # 16 bits: radix sort
        begin, end, token, length = begin[order] + shift[order], end[order] + shift[order], token[order], length[order]
        bytes_of = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        count = np.zeros(len(points) + len(chunks), np.int64)
        last = np.full(len(count), self.start, np.int64)
        done = np.zeros(len(count), bool)
        bounds = np.searchsorted(length, np.arange(1, int(length.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            raw = t == self.byte
            ok = raw.copy()
            if not raw.all():
                before = last[b]
                before[before == self.byte] = self.start
                ok[~raw] = self._kept(before[~raw], t[~raw])
            b, e, t = b[ok], e[ok], t[ok]
            last[e], done[e] = t, True
            weight = np.ones(len(b), np.int64)
            if raw.any():
                bare = t == self.byte
                weight[bare] = bytes_of[e[bare] - 1 - owner_of(e[bare], ends, len(chunks))]
            count[e] = count[b] + weight
        starts = ends - sizes + np.arange(len(chunks))
        done[starts] = True
        if not done.all():
            raise ValueError("a prefix has no last token: the model's merges are not in byte-pair order")
        return count, starts

    def totals(self, keys: Iterable[str], cache: dict[str, int], prefix: str) -> None:
        """Put the count of each new key into ``cache``; ``prefix`` goes before keys that start no line."""
        new = list({k for k in keys if k not in cache})
        if not new:
            return
        count, starts = self.prefix_counts([k if k[:1] == "\n" else prefix + k for k in new])
        stops = np.append(starts[1:], len(count)) - 1
        cache.update(zip(new, count[stops].tolist()))

    def split(self, text: str) -> tuple[list[str], bool]:
        """The chunks of a text as cache keys, and whether they are words (a blank goes before)."""
        if "  " in text or BLANK in text or text[:1] == " ":
            return _CHUNK.findall(BLANK + text.replace(" ", BLANK)), False
        return text.replace("\n", " \n").split(" "), True

    def counts(self, texts: list[str]) -> list[tuple[list[str], bool, list[int]]]:
        """For each text its chunks, their kind and their counts."""
        for cache in (self.words, self.chunks):
            if len(cache) > REMEMBERED:
                cache.clear()
        cut = [self.split(t) if t else ([], True) for t in texts]
        for plain, cache, prefix in ((True, self.words, BLANK), (False, self.chunks, "")):
            self.totals({k for keys, kind in cut if kind is plain for k in keys}, cache, prefix)
        return [(k, w, list(map((self.words if w else self.chunks).__getitem__, k))) for k, w in cut]

    def whole(self, keys: list[str], plain: bool) -> list[str]:
        return [k if not plain or k[:1] == "\n" else BLANK + k for k in keys]

    def fitting(self, keys: list[str], plain: bool, counts: list[int], budget: int) -> int:
        """Characters of the longest prefix of the text with ``budget`` tokens or fewer."""
        total = np.cumsum(counts)
        k = int(np.searchsorted(total, budget, side="right"))
        chunks = self.whole(keys[: k + 1], plain)
        size = sum(map(len, chunks[:k]))
        if k < len(keys):
            inner, _ = self.prefix_counts([chunks[k]])
            size += int(np.flatnonzero(inner <= budget - (int(total[k - 1]) if k else 0)).max())
        return max(0, size - 1)  # the blank before the text is not in it

    def table(self, text: str) -> np.ndarray:
        """Token count of every prefix of the text, the empty prefix and the whole text included."""
        if not text:
            return np.zeros(1, np.int64)
        chunks = self.whole(*self.split(text))
        count, starts = self.prefix_counts(chunks)
        stops = np.append(starts[1:], len(count)) - 1
        before = np.concatenate([[0], np.cumsum(count[stops])[:-1]])
        spread = np.repeat(before, np.diff(np.append(starts, len(count))))
        full = np.delete(count + spread, starts)
        full[0] = 0  # the blank alone stands for the empty text
        return full


def owner_of(entry: np.ndarray, ends: np.ndarray, chunks: int) -> np.ndarray:
    """Number of the chunk that a table entry belongs to."""
    return np.searchsorted(ends + np.arange(1, chunks + 1), entry, side="right")


def _groups(texts: list[str]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_table: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chars``.

    ``fit_chars`` answers truncation: the characters of the longest prefix within ``limit`` tokens.
    ``with_table`` adds ``prefix_tokens``, the counts of all prefixes, for any other question.
    Null and empty texts have no tokens.  Rows that share an id, and null ids, keep their rows.
    An empty table gives an empty result; other input columns are not read.  The model file is read
    on the driver and travels with the job (half a megabyte).
    """
    model = read_model(model_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = PrefixTable(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            total, fit, rows = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
            for group in _groups(texts):
                for i, (keys, plain, counts) in zip(group, tables.counts([texts[i] for i in group])):
                    total[i] = sum(counts)
                    fit[i] = len(texts[i]) if total[i] <= limit else tables.fitting(keys, plain, counts, limit)
            columns = [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fit)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if with_table:
                columns.append(pa.array([tables.table(t).astype(np.int32) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(count, schema + ", prefix_tokens array<int>" * with_table)
