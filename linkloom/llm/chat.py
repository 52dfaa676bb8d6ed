r"""Chat formatting with typed content parts, a loss mask and a reversible escape.

A turn is written as ``<turn ROLE>``, a line end, its body, a line end, ``</turn>`` and a line end.
The body is what a visitor makes of the content parts, in order: text parts give their text, other
parts a placeholder ``<KIND N>`` with the part's number in the turn.  Inside roles and texts ``\``,
``<`` and ``>`` get a ``\`` before them, so an unescaped ``<`` is always a mark and every text can
be read back.  For each placeholder the attachment's reference and the tokens that it expands to
are recorded.

Turns are formatted where they lie.  Only then are they dealt by conversation and sorted by turn, so
that places in the conversation and its digests can be taken in one pass; that pass holds one row
at a time, whatever a conversation's length.  A digest reads its text in order, so the turns of
one conversation do pass through one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import shuffle_width

ASSISTANT = "assistant"
PART = "kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int"
#: Tokens that attachments expand to: patches of an image, frames of a second, a page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 1024
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    for sign in ("\\", "<", ">"):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _image_tokens(part: Column) -> Column:
    return F.ceil(part.getField("width") / PATCH) * F.ceil(part.getField("height") / PATCH)


def _audio_tokens(part: Column) -> Column:
    return F.ceil(part.getField("seconds") * FRAMES)


def _document_tokens(part: Column) -> Column:
    return part.getField("pages").cast("long") * PAGE_TOKENS


#: The visitor: what each kind of attachment expands to; any other kind is text.
ATTACHMENTS: dict[str, Callable[[Column], Column]] = {
    "image": _image_tokens,
    "audio": _audio_tokens,
    "document": _document_tokens,
}


def visit(part: Column, index: Column) -> Column:
    """One flattened part: its string, whether it is text, and its attachment record."""
    kind = F.coalesce(part.getField("kind"), F.lit("text"))
    tokens = F.lit(None).cast("long")
    for name, expand in ATTACHMENTS.items():
        tokens = F.when(kind == name, F.coalesce(expand(part).cast("long"), F.lit(0))).otherwise(tokens)
    attached = kind.isin(*ATTACHMENTS)
    number = index + 1
    return F.struct(
        F.when(attached, F.concat(F.lit("<"), kind, F.lit(" "), number.cast("string"), F.lit(">")))
        .otherwise(escaped(F.coalesce(part.getField("text"), F.lit(""))))
        .alias("string"),
        (~attached).alias("is_text"),
        F.struct(number.alias("number"), kind.alias("kind"), part.getField("ref").alias("ref"), tokens.alias("tokens")).alias("attachment"),
    )


def render_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, rendered, mask, attachments, expanded_tokens`` of ``turns``.

    ``turns`` has ``conv_id, turn, role`` and ``parts``, an array of ``PART``.  ``mask`` lists the
    spans (start, end) of an assistant's texts in ``rendered``, in code points.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit("<turn "), escaped(role), F.lit(">\n"))
    flat = turns.withColumn("flat", F.transform(F.coalesce("parts", F.array().cast(f"array<struct<{PART}>>")), visit))
    body = F.array_join(F.transform("flat", lambda p: p.string), "")
    spans = F.aggregate(
        "flat",
        F.struct(F.char_length(head).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans")),
        lambda held, p: F.struct(
            (held.at + F.char_length(p.string)).alias("at"),
            F.when(
                p.is_text,
                F.concat(held.spans, F.array(F.struct(held.at.alias("start"), (held.at + F.char_length(p.string)).alias("end")))),
            ).otherwise(held.spans).alias("spans"),
        ),
        lambda held: held.spans,
    )
    attached = F.transform(F.filter("flat", lambda p: ~p.is_text), lambda p: p.attachment)
    return flat.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.concat(head, body, F.lit("\n</turn>\n")).alias("rendered"),
        F.when(role == ASSISTANT, spans).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("mask"),
        attached.alias("attachments"),
        F.coalesce(F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a.tokens), F.lit(0).cast("long")).alias("expanded_tokens"),
    )


_FORMATTED = (
    "conv_id long, turn long, rendered string, offset long, mask array<struct<start: bigint, end: bigint>>, "
    "attachments array<struct<number: int, kind: string, ref: string, tokens: bigint>>, expanded_tokens long"
)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, at, begun = None, 0, False
    for batch in batches:
        names = batch.schema.names
        offsets, masks = [], []
        ids, texts, spans = (batch.column(names.index(n)).to_pylist() for n in ("conv_id", "rendered", "mask"))
        for i, text, own in zip(ids, texts, spans):
            if not begun or i != conv:
                conv, at, begun = i, 0, True
            offsets.append(at)
            masks.append([{"start": at + s["start"], "end": at + s["end"]} for s in own])
            at += len(text)
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        columns["offset"] = pa.array(offsets, pa.int64())
        columns["mask"] = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        order = ["conv_id", "turn", "rendered", "offset", "mask", "attachments", "expanded_tokens"]
        yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted conversations, one row per turn, in order inside each partition.

    ``rendered`` of a conversation's rows, put together by ``offset``, is its formatted text;
    ``offset`` and ``mask`` count code points in it.  ``turns`` has ``conv_id, turn, role`` and
    ``parts`` or ``text`` (null: empty).  Turns are ordered by number, null last, then role, then
    content, so repeated rows are all kept in a fixed order.  Null conversation ids form one
    conversation; a null role is empty.  An empty table gives an empty result; other columns are
    not read.
    """
    if "parts" not in turns.columns:
        none = F.lit(None)
        part = F.struct(
            F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), none.cast("string").alias("ref"),
            none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
        turns = turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))
    return (
        render_turns(turns)
        .repartition(shuffle_width(turns), "conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "rendered")
        .mapInArrow(_place, _FORMATTED)
    )


def parse_turn(rendered: str) -> tuple[str, str]:
    """Role and body of a formatted turn; the body without placeholders, unescaped."""
    if not rendered.startswith("<turn ") or not rendered.endswith("\n</turn>\n"):
        raise ValueError("not a formatted turn")
    head = re.match(r"<turn ((?:[^\\>]|\\.)*)>\n", rendered, re.S)
    body = rendered[head.end() : -len("\n</turn>\n")]
    return unescaped(head[1]), unescaped(re.sub(r"((?:[^\\<]|\\.)*)(?:<[^>]*>)?", r"\1", body, flags=re.S))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state: list | None = None

    def rows(done: list[list]) -> pa.RecordBatch:
        table = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]] for s in done]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types)], names)

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if state is None or state[0] != r["conv_id"]:
                if state is not None:
                    done.append(state)
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = parse_turn(r["rendered"])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in r["mask"]:
                own = unescaped(r["rendered"][span["start"] - r["offset"] : span["end"] - r["offset"]])
                state[3] += len(own)
                state[4].update(own.encode("utf-8", "surrogatepass"))
            state[5] += len(r["rendered"])
            state[6] += r["expanded_tokens"]
        if done:
            yield rows(done)
    if state is not None:
        yield rows([state])


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, from the formatted text and mask alone.

    Columns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    expanded_tokens``.  ``in_order`` says that ``formatted`` comes straight from
    ``format_conversations``; a stored table is dealt and sorted anew.
    """
    if not in_order:
        formatted = formatted.repartition(shuffle_width(formatted), "conv_id").sortWithinPartitions("conv_id", "offset")
    return formatted.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long",
    )
