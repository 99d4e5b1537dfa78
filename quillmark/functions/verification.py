"""How well a profile title fits a person and firm: agreement flags and score ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import vocabulary as V
from quillmark.functions.names import firm_words, name_parts
from quillmark.functions.text import WORD


def _present(words: Column, title: Column) -> Column:
    """The words that stand bounded in the title, in order."""
    quoted = lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")
    return F.filter(words, lambda w: F.coalesce(F.regexp_like(title, F.concat(F.lit(f"(?<!{WORD})"), quoted(w), F.lit(f"(?!{WORD})"))), F.lit(False)))


def name_match(name: Column, title: Column) -> dict[str, Column]:
    """``matched_first``, ``matched_last``, ``match_type`` and ``verified`` (either part is there)."""
    low = F.lower(title)
    firsts, lasts = name_parts(name)
    first, last = F.try_element_at(_present(firsts, low), F.lit(1)), F.try_element_at(_present(lasts, low), F.lit(1))
    kind = F.when(first.isNotNull() & last.isNotNull(), "both").when(first.isNotNull(), "first_name").when(last.isNotNull(), "last_name").otherwise("none")
    return {"matched_first": first, "matched_last": last, "match_type": kind, "name_verified": kind != "none"}


def firm_match(firm: Column, title: Column) -> Column:
    return _present(firm_words(firm), F.lower(title))


def board_phrases(title: Column) -> Column:
    return F.filter(F.array(*map(F.lit, V.BOARD_PHRASES)), lambda k: F.coalesce(F.lower(title).contains(k), F.lit(False)))


def general_score(first: Column, last: Column, firm: Column) -> Column:
    """100 full name and firm, 90 full name, 70 part and firm, 60 part, 30 firm only, 0 nothing."""
    both, any_ = first & last, first | last
    return F.when(both & firm, 100).when(both, 90).when(any_ & firm, 70).when(any_, 60).when(firm, 30).otherwise(0)


def director_score(first: Column, last: Column, firm: Column, board: Column) -> Column:
    """Ladder for directors, whose titles seldom name the board's firm; 70 cannot be reached."""
    both, any_ = first & last, first | last
    return F.when(both & board & firm, 100).when(both & board, 95).when(both, 90).when(any_ & board & firm, 85).when(any_ & board, 80).when(any_, 60).when(firm, 30).otherwise(0)


def quality(score: Column) -> Column:
    return F.when(score >= 95, "EXCELLENT").when(score >= 80, "GOOD").when(score == 70, "GOOD").when(score == 60, "WEAK").when(score == 30, "WRONG_PERSON").otherwise("NO_MATCH")
