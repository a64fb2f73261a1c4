"""Tokens, identifier splitting and snippets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token class (letters and numbers; everything else separates).
TOKEN_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"
SEPARATOR_PATTERN = r"[^\p{IsAlphabetic}\p{N}]+"

# Places where an identifier is broken up. Lower to upper case;
# before the last capital of a run of capitals when lower case follows, which
# wants two capitals before the break, or one if it opens the text; digit to
# letter; letter to digit. The cheapest test of each comes first, since nearly
# every position fails it.
IDENTIFIER_BREAKS = "|".join(
    [
        r"(?=\p{IsUppercase})(?:(?<=\p{IsLowercase})"
        r"|(?:(?<=\p{IsUppercase}\p{IsUppercase})|(?<=\A\p{IsUppercase}))(?=.\p{IsLowercase}))",
        r"(?<=[0-9])(?=\p{IsAlphabetic})",
        r"(?=[0-9])(?<=\p{IsAlphabetic})",
    ]
)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order. No stemming, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """The words of :func:`tokens` in one string, with a space between two."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATOR_PATTERN, " "))


def split_identifiers(text: Column) -> Column:
    """Put a space at every case and digit boundary."""
    return F.regexp_replace(text, IDENTIFIER_BREAKS, " ")


def expand_identifiers(text: Column) -> Column:
    """The text, followed by its split form on a new line when that differs."""
    # distinct over the pair names the split once, so it is computed once
    return F.array_join(F.array_distinct(F.array(text, split_identifiers(text))), "\n")


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def first_word(query: Column) -> Column:
    """First whitespace-separated word of a raw query, lower-cased."""
    return F.lower(F.regexp_extract(query, r"(?U)(\S+)", 1))


def snippet(text: Column, query: Column, width: int) -> Column:
    """At most ``width`` characters around the query's first word, on one line.

    Where the word does not occur the snippet is the start of the text. An
    ellipsis marks each side that was cut.
    """
    needle = first_word(query)
    found = F.instr(F.lower(text), needle)
    centre = F.when(needle == "", 0).otherwise(F.greatest(found - 1, F.lit(0)))
    start = F.greatest(centre - width // 2, F.lit(0))
    window = F.substring(text, start + 1, F.lit(width))
    trimmed = F.regexp_replace(window, r"(?U)^\s+|\s+$", "")
    marked = F.concat(
        F.when(start > 0, "…").otherwise(""),
        trimmed,
        F.when(start + width < F.char_length(text), "…").otherwise(""),
    )
    return F.regexp_replace(marked, r"(?U)\s+", " ")
