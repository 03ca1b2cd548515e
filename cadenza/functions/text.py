"""Text normal forms as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Lower-case words of a text in order: runs of letters, digits and apostrophes."""
    return F.array_remove(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}']+"), "")


def split_multivalue(c: str | Column, sep: str = ",") -> Column:
    """``'Rock, pop,rock'`` -> ``['rock', 'pop']``."""
    return F.filter(F.array_distinct(F.transform(F.split(_c(c), sep), lambda t: F.lower(F.trim(t)))), lambda t: t != "")


def normal_name(c: str | Column) -> Column:
    """Entity-name normal form: lower case, single spaces, no leading article."""
    squeezed = F.trim(F.regexp_replace(F.lower(_c(c)), r"[ \t\r\n]+", " "))
    return F.regexp_replace(squeezed, "^the ", "")


def song_text(title: Column, artist: Column, genres: Column, tags: Column) -> Column:
    """One line describing a song, the input of a text embedding."""
    return F.concat_ws(" | ", title, artist, F.array_join(genres, ", "), F.array_join(tags, ", "))
