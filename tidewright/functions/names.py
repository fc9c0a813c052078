"""Names and words of source texts, as column expressions: words are told apart first and looked up in plain lists."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def parts(name: Column) -> Column:
    """The lower-case parts of a name between underscores."""
    return F.split(F.lower(name), "_")


def last_part(name: Column) -> Column:
    return F.element_at(parts(name), -1)


def has_part(name: Column, listed: Iterable[str]) -> Column:
    return F.arrays_overlap(parts(name), F.array(*map(F.lit, listed)))


def words(text: Column) -> Column:
    """The identifiers of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))


def has_word(text: Column, listed: Iterable[str]) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, listed)))


def has_phrase(text: Column, listed: Iterable[str]) -> Column:
    """Whether words follow each other as in one of the phrases."""
    line = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return any_of(line.contains(f" {p} ") for p in listed)


def contains_any(text: Column, listed: Iterable[str]) -> Column:
    return any_of(text.contains(x) for x in listed)


def squeezed(text: Column, marks: str = " \t\n\r._-") -> Column:
    """The text in lower case without these marks."""
    return F.translate(F.lower(text), marks, "")
