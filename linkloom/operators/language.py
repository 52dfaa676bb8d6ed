"""Language of a text by profiles of three-letter runs that are learned from labelled texts.

Profiles are counted by one grouped aggregation: how often each bucket of letter runs occurs in a
language.  A fitted profile is a fixed number of log probabilities per language, so it travels inside a
column expression and a text is judged without a join and without leaving the JVM.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as T

#: Runs share a bucket if their code points agree in this rule; also the length of a profile.
BUCKETS = 4096
N_WORDS = 30
_CODE = (961, 31, 1)


def letter_runs(text: Column, n_words: int = N_WORDS) -> Column:
    """Buckets of the three-letter runs of the first ``n_words`` words, lower case, a blank around each word."""
    opening = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), 1, n_words)
    signs = F.split(F.concat(F.lit(" "), F.array_join(opening, " "), F.lit(" ")), "")
    codes = F.transform(F.filter(signs, lambda s: s != ""), lambda s: F.ascii(s))

    def buckets(c: Column) -> Column:
        at = F.when(F.size(c) >= 3, F.sequence(F.lit(0), F.size(c) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: sum(F.get(c, i + k) * w for k, w in enumerate(_CODE)) % BUCKETS)

    return T.once(codes, buckets)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", n_words: int = N_WORDS) -> dict[str, list[float]]:
    """Log probability of each bucket in each language, smoothed by one count.

    Rows without a text or language are left out.  The result has ``BUCKETS`` numbers per language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    runs = rows.select(F.col(lang).alias("lang"), F.explode(letter_runs(F.col(text), n_words)).alias("bucket"))
    counts: dict[str, dict[int, int]] = {}
    for r in runs.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["bucket"]] = r["n"]
    return {
        name: [math.log((own.get(b, 0) + 1) / (sum(own.values()) + BUCKETS)) for b in range(BUCKETS)]
        for name, own in sorted(counts.items())
    }


def _total(runs: Column, logs: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(logs)), "array<double>")  # a literal once the plan is optimised
    return F.aggregate(runs, F.lit(0.0), lambda total, b: total + F.get(table, b))


def detector(profiles: Mapping[str, list[float]], n_words: int = N_WORDS) -> T.Detector:
    """The most likely language of a text column; the first by name on ties, NULL without letters."""

    def detect(text: Column) -> Column:
        def likeliest(runs: Column) -> Column:
            rated = []
            for place, (name, logs) in enumerate(profiles.items()):
                rated.append(F.struct(_total(runs, logs).alias("score"), F.lit(-place).alias("turn"), F.lit(name).alias("lang")))
            return F.when(F.size(runs) > 0, F.array_max(F.array(*rated))["lang"])

        return T.once(letter_runs(text, n_words), likeliest)

    return detect
