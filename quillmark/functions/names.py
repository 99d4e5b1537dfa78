"""Cleaning of person and firm names, and their match keys, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import vocabulary as V
from quillmark.functions.text import title_case


def _without(x: Column, patterns: list[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, f"(?iU){p}", ""), patterns, x)


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _capitals(x: Column) -> Column:
    """Title case where the whole is upper case and longer than three signs; 'S is put right."""
    return F.regexp_replace(F.when((x == F.upper(x)) & (F.length(x) > 3), title_case(x)).otherwise(x), r"'S\b", "'s")


def clean_person(name: Column, variant: str = "generic") -> Column:
    """A person's name without degrees, its first generational suffix at the end.

    Variants: ``generic`` (dots become blanks, all-capital names in title case), ``full`` (longer list
    of degrees, dots become blanks, suffix without dot), ``pilot`` (dots kept, suffix as written)."""
    suffix = F.regexp_extract(name, f"(?i){V.GENERATIONS}", 0)
    x = _without(F.trim(name), V.CREDENTIALS[variant])
    x = F.when(suffix != "", F.regexp_replace(x, f"(?i){V.GENERATIONS}", "")).otherwise(x)
    if variant == "generic":
        x = _squeeze(F.regexp_replace(F.regexp_replace(x, r"\.+", " "), r"\s*,\s*", " "))
        x = _capitals(x)
        fixed = title_case(suffix)
        end = F.when(fixed.isin("Ii", "Iii", "Iv"), F.upper(suffix)).otherwise(suffix)
    elif variant == "full":
        x = _squeeze(F.regexp_replace(F.regexp_replace(x, r"\s*,\s*", " "), r"\.+", " "))
        end = F.replace(suffix, F.lit("."), F.lit(""))
    else:
        x = _squeeze(F.regexp_replace(x, r"\s*,\s*", " "))
        end = suffix
    return F.trim(F.when(suffix != "", F.concat(x, F.lit(" "), end)).otherwise(x))


def clean_firm(name: Column, titled: bool = True) -> Column:
    """A firm's name without its legal endings; ``titled`` also puts all-capital names in title case."""
    x = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), V.FIRM_ENDINGS, F.trim(name))
    return _squeeze(_capitals(x) if titled else x)


def sec_person(name: Column) -> Column:
    """Filing-style name in title case; trailing II, III, IV restored."""
    x = title_case(F.trim(name))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r" Iii$", " III"), r" Ii$", " II"), r" Iv$", " IV")


def sec_firm(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(title_case(F.trim(name)), r"\bLlc\b", "LLC"), r"\bLp\b", "LP")


def person_key(name: Column) -> Column:
    return F.coalesce(F.lower(_squeeze(name)), F.lit(""))


def firm_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(person_key(name), r"[,\s]+(?:inc\.?|corp\.?|co\.?|ltd\.?|llc\.?|l\.p\.)$", ""))


def name_parts(name: Column, credentials: list[str] | None = None) -> tuple[Column, Column]:
    """(first-name variants in order of precedence, last names). Variants: the name itself, its short
    forms, the formal names it is short for. Null or empty names have none."""
    x = _without(F.trim(F.coalesce(name, F.lit(""))), credentials or V.CREDENTIALS["parts"])
    x = F.lower(_squeeze(F.regexp_replace(x, r"\.+", " ")))
    parts = F.filter(F.split(x, " "), lambda t: t != "")
    first = F.try_element_at(parts, F.lit(1))
    shorts = F.create_map(*[c for k, v in V.NICKNAMES.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    back: dict[str, list[str]] = {}
    for formal, nicks in V.NICKNAMES.items():
        for n in nicks:
            back.setdefault(n, []).append(formal)
    formals = F.create_map(*[c for k, v in back.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    firsts = F.when(first.isNull(), none).otherwise(F.array_distinct(F.concat(F.array(first), F.coalesce(F.try_element_at(shorts, first), none), F.coalesce(F.try_element_at(formals, first), none))))
    rest = F.filter(F.slice(parts, 2, 1 << 20), lambda t: (F.length(t) > 1) & ~t.isin(*V.GENERATION_WORDS))
    lasts = F.when(F.size(rest) > 0, F.slice(rest, -1, 1)).otherwise(none)
    return firsts, lasts


def firm_words(name: Column) -> Column:
    """The words of a firm's name that tell it apart."""
    x = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), V.FIRM_ENDINGS_WIDE, F.lower(F.coalesce(name, F.lit(""))))
    x = _squeeze(F.regexp_replace(x, r"(?U)[^\w\s-]", " "))
    own = F.trim(F.coalesce(name, F.lit("")))
    keep = F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(*V.NOISE_WORDS) & ~w.rlike("^[0-9]+$") & ((F.length(w) > 3) | ((F.length(w) >= 2) & (F.upper(w) == own))))
    short = (F.size(keep) == 0) & F.length(own).between(2, 4)
    return F.when(short, F.array(F.lower(own))).otherwise(keep)


def search_query(name: Column, firm: Column) -> Column:
    """Null if either part is null."""
    return F.concat(name, F.lit(" "), firm)


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
