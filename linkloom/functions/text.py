"""Text expressions on columns.  All of them work on the whole text of a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() sees it, word characters, token and marker forms.
WHITESPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
UNEVEN_SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85&&[^ ]][\s\p{Z}\x0B\x1C-\x1F\x85]*| [\s\p{Z}\x0B\x1C-\x1F\x85]+"  # all but one blank
PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_RUN = r"[\p{L}\p{N}_]+"
DIGITS_ONLY = r"^\p{Nd}+$"
NULL_MARKS = r"^(n/a|[\s\p{Z}\x0B\x1C-\x1F\x85]+)$"
MISSING_VALUES = ("", "0", " ", "None")
TITLE_MARK = "TITLE: "
TEXT_MARK = "TEXT: "
DELIMITER = "{-}"
DELIMITER_PATTERN = r"\{-\}"

# Frequent words per language for the language profile.
LANGUAGE_PROFILES = {
    "en": "the and of to in is that it for was with as are on be at by this or",
    "fr": "le la les des et un une que qui pour par du est dans en de elle",
    "de": "der die das und ist nicht ein eine mit auf für von den zu es sie auch",
    "es": "el los las y una por con para se del al como lo su que de la en es un",
}


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.array_size(words(text)), F.lit(0)).cast("long")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNEVEN_SPACE, " "))


def collapsed_word_count(text: Column) -> Column:
    """``word_count`` of a text with single blanks between its words and none around them."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(F.coalesce(blanks + 1, F.lit(0))).cast("long")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def bare_words(text: Column) -> Column:
    """Lower-cased words without punctuation: the unit of longest-common-run comparison."""
    return words(F.lower(strip_punctuation(text)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_numeric_term(term: Column) -> Column:
    return term.rlike(DIGITS_ONLY)


def null_if_marked(value: Column) -> Column:
    """NULL for ``n/a`` and for text made of whitespace only."""
    return F.when(~value.rlike(NULL_MARKS), value)


def is_missing(value: Column) -> Column:
    return value.isNull() | value.isin(*MISSING_VALUES)


def split_marked(content: Column) -> tuple[Column, Column]:
    """(title, body) of ``TITLE: ...\\nTEXT: ...``.

    The order of the rewrites is part of the contract: newlines are deleted, not replaced, so the
    words around one are joined.  Only the first body marker splits.
    """
    parts = marked_parts(content)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def marked_parts(content: Column) -> Column:
    flat = F.replace(content, F.lit(TITLE_MARK), F.lit(""))
    flat = F.replace(flat, F.lit("\n"), F.lit(""))
    flat = F.replace(flat, F.lit(TEXT_MARK), F.lit(DELIMITER))
    return F.split(flat, DELIMITER_PATTERN, 2)


def compose(title: Column, body: Column) -> Column:
    """``title: body``."""
    return F.concat(title, F.lit(": "), body)


def language_by_profile(
    text: Column, profiles: dict[str, str] | None = None, n_words: int = 30
) -> Column:
    """Best language by hits of frequent words among the first words of the text.

    English wins ties; the value is NULL when no profile is hit at all.
    """
    profiles = profiles or LANGUAGE_PROFILES
    opening = F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{N}}_]*{WORD_RUN}){{0,{n_words}}}", 0)
    found = F.slice(F.regexp_extract_all(F.lower(opening), F.lit(WORD_RUN), F.lit(0)), 1, n_words)

    def scored(words_found: Column) -> Column:
        candidates = []
        for place, (lang, listed) in enumerate(profiles.items()):
            known = F.array(*[F.lit(w) for w in listed.split()])
            hits = F.size(F.filter(words_found, lambda w: F.array_contains(known, w)))
            candidates.append(F.struct(hits.alias("hits"), F.lit(-place).alias("turn"), F.lit(lang).alias("lang")))
        return F.array_max(F.array(*candidates))

    best = once(found, scored)
    return once(best, lambda b: F.when(b["hits"] > 0, b["lang"]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


Detector = Callable[[Column], Column]


def experiment_name(parts: Sequence[Column]) -> Column:
    """Underscore-joined name of an experiment from its parameters."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def day_stamp() -> Column:
    """Today as dd-MM-yy."""
    return F.date_format(F.current_date(), "dd-MM-yy")


def interleave(first: Column, second: Column) -> Column:
    """``a1, b1, a2, b2, ...`` of two lists; what one list lacks is left out."""
    longest = F.greatest(F.array_size(first), F.array_size(second))
    at = F.sequence(F.lit(1), longest)
    return F.filter(
        F.flatten(F.transform(at, lambda i: F.array(F.try_element_at(first, i), F.try_element_at(second, i)))),
        lambda x: x.isNotNull(),
    )
