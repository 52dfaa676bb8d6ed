"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes.  Distinct blocks are sorted (by hash, then by
content) and numbered 0, 1, 2, ..., so a block has one integer name; then adjacent names are paired,
the distinct pairs are sorted and numbered in the same way, and so on until each document is one
name.  Two documents have the same ``(number of blocks, name)`` exactly when their texts are equal.
Names depend on the set of texts only, not on how the rows or the shuffles are dealt.

The text itself is shuffled once, for the distinct blocks, with a map-side combine.  Documents
carry only the 64-bit hash of a block to the join with the names.  A hash that stands for one
distinct block, which the distinct step has established by comparing the blocks themselves, is as
good as the block; blocks whose hash stands for several are named and joined by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import BLANKS
from linkloom.operators.ordering import with_global_index
from linkloom.runtime import materialize, scratch

BLOCK_BYTES = 4096
#: Every run of blanks but the lone space, which is its own replacement.
_RUN = rf"[\x09-\x0D][{BLANKS}]*|\x20[{BLANKS}]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """The rows numbered 0, 1, 2, ... in the order of ``keys``, written."""
    return materialize(with_global_index(distinct, [F.col(k) for k in keys], "name"))


def _blocks(data: Column, n: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: ``row`` (all input columns), identity, group and verdict.

    Columns: ``row`` struct, ``doc_id``, ``text_sha256``, ``n_blocks``, ``name``, ``keep_id``,
    ``group_size``, ``kept``.  Null text equals empty text.  In a group the smallest id stays, null
    ids rank last; of several rows with that id exactly one has ``kept`` true.  An empty table gives
    an empty result.  Input columns sit inside ``row``, so no name can clash.  ``hash_bits`` below
    64 makes block hashes collide and exists for tests.
    """
    staged = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("rid", F.monotonically_increasing_id()))
    data = normalised(F.col("row").getField(text_col)).cast("binary")
    cut = (
        staged.select("rid", F.col("row").getField(id_col).alias("doc_id"), data.alias("data"))
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int"))
        .withColumn("blocks", _blocks(F.col("data"), F.col("n"), block_bytes))
    )
    mask = F.lit(-1 if hash_bits == 64 else (1 << hash_bits) - 1).cast("long")

    def code(block: Column) -> Column:
        return F.xxhash64(block).bitwiseAND(mask)

    with scratch(docs.sparkSession) as keep:  # only what the result reads stays on disk
        heads = materialize(
            cut.select(
                "rid", "doc_id", "n", F.sha2("data", 256).alias("text_sha256"), F.transform("blocks", code).alias("codes")
            )
        )
        pieces = cut.select("rid", F.posexplode("blocks").alias("idx", "block")).withColumn("code", code(F.col("block")))
        codes = materialize(pieces.groupBy("code", "block").agg(F.lit(1)).select("code"))
        # One row per key, written before it is joined: both sides of the join are plain shuffles then,
        # and Spark splits the partition of a block or a name that a large share of documents has.
        per_code = _numbered(codes.groupBy("code").agg(F.count(F.lit(1)).alias("k")), "code")
        shared = per_code.where("k > 1").select("code")
        spots = heads.select("rid", "n", F.posexplode("codes").alias("idx", "code"))
        plain = spots.join(per_code.where("k = 1").select("code", "name"), "code").select("rid", "n", "idx", "name")
        if shared.isEmpty():
            level = plain
        else:
            collided = materialize(pieces.join(shared, "code"))
            by_content = _numbered(collided.select("code", "block").distinct(), "code", "block")
            again = (
                collided.join(by_content, ["code", "block"])
                .select("rid", "idx", (-1 - F.col("name")).alias("name"))
                .join(heads.select("rid", "n"), "rid")
                .select("rid", "n", "idx", "name")
            )
            level = plain.unionByName(again)

        longest = heads.agg(F.max("n")).first()[0] or 1
        width, roots = 1, []
        while True:
            roots.append(level.where((F.col("n") > width // 2) & (F.col("n") <= width)).select("rid", "name"))
            if width >= longest:
                break
            pairs = materialize(
                level.where(F.col("n") > width)
                .groupBy("rid", "n", F.shiftright("idx", 1).alias("half"))
                .agg(
                    F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("l"),
                    F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("r"),
                )
                .withColumn("lone", F.col("r").isNull())
                .withColumn("r", F.coalesce("r", F.lit(0)))
            )
            pair_names = _numbered(pairs.select("l", "r", "lone").distinct(), "l", "r", "lone")
            level = pairs.join(pair_names, ["l", "r", "lone"]).select("rid", "n", F.col("half").alias("idx"), "name")
            width *= 2

        root = roots[0]
        for more in roots[1:]:
            root = root.unionByName(more)
        known = keep(materialize(heads.select("rid", "doc_id", "n", "text_sha256").join(root, "rid")))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
        groups = keep(materialize(known.groupBy("n", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))))
    judged = known.join(groups, ["n", "name"]).select(
        "rid",
        "doc_id",
        "text_sha256",
        F.col("n").cast("long").alias("n_blocks"),
        "name",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.rid") == F.col("rid")).alias("kept"),
    )
    return staged.join(judged, "rid").drop("rid")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with the input's columns."""
    return name_documents(docs, id_col, text_col).where("kept").select("row.*")
