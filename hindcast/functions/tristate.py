"""Tri-state signs: 1 = need shown, 0 = need ruled out, NULL = unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_answer(answers: Sequence[str], reversed_answers: Sequence[str] = ()) -> Column:
    """NULL without answers; 1 if an answer is 1 or a reversed one is 0; otherwise 0."""
    answered = F.coalesce(*[F.col(a) for a in answers])
    shown = F.lit(1).isin(*[F.col(a) for a in answers])
    if reversed_answers:
        shown = shown | F.lit(0).isin(*[F.col(a) for a in reversed_answers])
    return F.when(answered.isNotNull(), F.when(shown, 1).otherwise(0))


def yes_no(flag: Column, yes: str = "Y", no: str = "N") -> Column:
    return F.when(flag == yes, 1).when(flag == no, 0)


def matches_without(texts: Sequence[str], pattern: str, exclusion: str) -> Column:
    """Some text matches `pattern` and none matches `exclusion`; a NULL text rules the row out."""
    hit, clean = F.lit(False), F.lit(True)
    for name in texts:
        hit = hit | F.col(name).rlike(pattern)
        clean = clean & ~F.col(name).rlike(exclusion)
    return hit & clean


def strongest(*signs: Column) -> Column:
    """1 if any sign is 1, else 0 if any is 0, else NULL."""
    return F.greatest(*signs)
