"""What a text query asks for: words and phrases in any-of or all-of groups.

A query is put together from these pieces, or read from a text with quoted
phrases, ``AND``, ``OR`` and brackets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loresift.functions import bm25
from loresift.functions.text import tokens

ANY, ALL = "any", "all"


@dataclass(frozen=True)
class Clause:
    """One word, or a phrase of several terms that must stand side by side."""

    terms: tuple[str, ...]

    @property
    def is_phrase(self) -> bool:
        return len(self.terms) > 1


@dataclass(frozen=True)
class Group:
    """Clauses, and groups inside, any or all of which must hold."""

    parts: tuple[Clause | Group, ...]
    match: str = ANY

    @property
    def clauses(self) -> list[Clause]:
        return [c for part in self.parts for c in (part.clauses if isinstance(part, Group) else [part])]


@dataclass(frozen=True)
class TextQuery:
    """Groups of clauses; ``raw`` is the text a snippet is centred by."""

    groups: tuple[Group, ...]
    match: str = ALL
    raw: str = ""

    @property
    def clauses(self) -> list[Clause]:
        return Group(self.groups).clauses

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(term for clause in self.clauses for term in clause.terms))

    @property
    def phrase_terms(self) -> set[str]:
        return {term for clause in self.clauses if clause.is_phrase for term in clause.terms}


def analyse(spark: SparkSession, pieces: list[str]) -> list[tuple[str, ...]]:
    """Terms of each piece, by the same expression that tokenises documents."""
    if not pieces:
        return []
    row = spark.sql("SELECT 1").select(F.array(*[tokens(F.lit(p)) for p in pieces]).alias("terms")).first()
    return [tuple(found) for found in row["terms"]]


def _clauses(spark: SparkSession, pieces: list[str]) -> tuple[Clause, ...]:
    return tuple(Clause(found) for found in analyse(spark, pieces) if found)


def words(spark: SparkSession, text: str, match: str = ANY) -> TextQuery:
    """Free text: each blank-separated word is a clause, a compound word a phrase."""
    return TextQuery((Group(_clauses(spark, text.split()), match),), ALL, text)


def phrase(spark: SparkSession, text: str) -> TextQuery:
    """All words of ``text`` next to each other, in order."""
    return TextQuery((Group(_clauses(spark, [text]), ALL),), ALL, text)


def boolean(spark: SparkSession, groups: list[tuple[str, list[str]]], match: str = ALL) -> TextQuery:
    """Groups ``(any or all, [word or phrase, ...])`` combined by ``match``."""
    built = [Group(_clauses(spark, pieces), how) for how, pieces in groups]
    raw = " ".join(piece for _, pieces in groups for piece in pieces)
    return TextQuery(tuple(g for g in built if g.parts), match, raw)


_SYNTAX = re.compile(r'"([^"]*)"?|([()])|([^\s()"]+)')


def parse(spark: SparkSession, text: str, match: str = ANY) -> TextQuery:
    """A query text: words, ``"phrases"``, ``AND``, ``OR`` and brackets.

    ``AND`` binds tighter than ``OR``; pieces side by side are joined by
    ``match``. Unbalanced brackets and dangling operators are passed over. A
    text without any of these is the same as ``words``.
    """
    found = [m.groups() for m in _SYNTAX.finditer(text)]
    if not any(phrase is not None or bracket or word in ("AND", "OR") for phrase, bracket, word in found):
        return words(spark, text, match)
    pieces = [phrase if phrase is not None else word for phrase, _, word in found]
    clause_of = dict(zip(dict.fromkeys(p for p in pieces if p), analyse(spark, list(dict.fromkeys(p for p in pieces if p)))))
    at = 0

    def joined(parts: list, how: str):
        parts = [p for p in parts if p]
        if len(parts) < 2:
            return parts[0] if parts else None
        flat = [q for p in parts for q in (p.parts if isinstance(p, Group) and p.match == how else [p])]
        return Group(tuple(flat), how)

    def one():
        nonlocal at
        phrase, bracket, word = found[at]
        at += 1
        if bracket == "(":
            inner = either()
            at += at < len(found)  # the closing bracket
            return inner
        terms = clause_of.get(phrase if phrase is not None else word)
        return Clause(terms) if terms else None

    def side_by_side():
        nonlocal at
        parts = []
        while at < len(found) and found[at][1] != ")" and (found[at][0] is not None or found[at][2] not in ("AND", "OR")):
            parts.append(one())
        return joined(parts, match)

    def both():
        nonlocal at
        parts = [side_by_side()]
        while at < len(found) and found[at][0] is None and found[at][2] == "AND":
            at += 1
            parts.append(side_by_side())
        return joined(parts, ALL)

    def either():
        nonlocal at
        parts = [both()]
        while at < len(found) and found[at][0] is None and found[at][2] == "OR":
            at += 1
            parts.append(both())
        return joined(parts, ANY)

    parts = []
    while at < len(found):
        parts.append(either())
        at += at < len(found)  # a bracket that closes nothing
    raw = " ".join(p for p, (phrase, _, word) in zip(pieces, found) if p and (phrase is not None or word not in ("AND", "OR")))
    whole = joined(parts, match)
    if whole is None:
        return TextQuery((), ALL, raw)
    if isinstance(whole, Clause):
        return TextQuery((Group((whole,)),), ALL, raw)
    if all(isinstance(p, Clause) for p in whole.parts):
        return TextQuery((whole,), ALL, raw)
    other = ALL if whole.match == ANY else ANY
    return TextQuery(tuple(Group((p,), other) if isinstance(p, Clause) else p for p in whole.parts), whole.match, raw)


def phrase_starts(positions: list[Column]) -> Column:
    """Positions at which the i-th list holds ``start + i``, for all lists."""
    return reduce(F.array_intersect, [_shifted(found, offset) for offset, found in enumerate(positions)])


def _shifted(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda at: at - offset) if offset else positions


def _combine(conditions: list[Column], match: str) -> Column:
    if not conditions:
        return F.lit(False)
    return reduce((lambda a, b: a & b) if match == ALL else (lambda a, b: a | b), conditions)


def frequencies(query: TextQuery, tf: dict[str, Column], positions: dict[str, Column]) -> dict[Clause, Column]:
    """Number of occurrences of each clause."""

    def occurrences(clause: Clause) -> Column:
        if not clause.is_phrase:
            return tf[clause.terms[0]]
        return F.size(phrase_starts([positions[t] for t in clause.terms]))

    return {clause: occurrences(clause) for clause in query.clauses}


def _holds(part: Clause | Group, tfs: dict[Clause, Column]) -> Column:
    if isinstance(part, Clause):
        return tfs[part] > 0
    return _combine([_holds(p, tfs) for p in part.parts], part.match)


def matched(query: TextQuery, tfs: dict[Clause, Column]) -> Column:
    """Whether a document satisfies the query, from its clause frequencies."""
    return _holds(Group(query.groups, query.match), tfs)


def score(query: TextQuery, tfs: dict[Clause, Column], dl: Column, avg_dl: Column, idf: dict[str, Column]) -> Column:
    """Sum of the clause scores of every satisfied group.

    A phrase weighs as much as its terms together.
    """

    def gain(part: Clause | Group) -> Column:
        if isinstance(part, Clause):
            clause_idf = reduce(lambda a, b: a + b, [idf[t] for t in part.terms])
            value = clause_idf * bm25.weight(tfs[part], dl, avg_dl)
        else:
            value = reduce(lambda a, b: a + b, map(gain, part.parts))
        return F.when(_holds(part, tfs), value).otherwise(0.0)

    return reduce(lambda a, b: a + b, map(gain, query.groups))
