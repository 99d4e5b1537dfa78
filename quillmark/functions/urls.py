"""Profile-address keys. Three keys are in use side by side and stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_query(url: Column) -> Column:
    """Up to ``?``, without trailing slashes; case kept."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def person_page(url: Column, compat: bool = True) -> Column:
    """Trimmed, trailing slash off, cut at ``?`` and ``#``, ``/posts/user-...`` as ``/in/user``, lower case.
    ``compat`` cuts the user of a post address at its first hyphen, as the data were keyed so far."""
    x = F.regexp_replace(F.trim(url), "/+$", "")
    x = F.substring_index(F.substring_index(x, "?", 1), "#", 1)
    user = r"/posts/([^/\-]+)[^/]*.*$" if compat else r"/posts/([^/]+?)(?:_[^/]*)?(?:/.*)?$"
    return F.lower(F.regexp_replace(x, user, "/in/$1"))


def with_query(url: Column) -> Column:
    """Trimmed, trailing slashes off, lower case; the query string stays."""
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


def username(url: Column) -> Column:
    """Segment after ``in``, else the last one."""
    after = F.regexp_extract(cut_query(url), r"/in/([^/]+)", 1)
    return F.when(after != "", after).otherwise(F.element_at(F.split(cut_query(url), "/"), -1))


def profile_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:posts|in)/([^/?]+)", 1), F.lit(""))
