"""Text kernels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import vocabulary as V

#: Letters, digits and underscore of any script, as the word boundary sees them.
WORD = r"[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Lower case; links, ``@`` and ``#`` removed; all but a-z and 0-9 separates; null gives no tokens."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, r"(?U)http\S+|www\S+", "")
    x = F.regexp_replace(x, "[@#]", "")
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    return F.filter(F.split(x, " "), lambda t: t != "")


def words_count(text: Column) -> Column:
    """Words between white space; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small letters otherwise (O'Neil, 3M, Hewlett-Packard)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))), "")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def safe_filename(text: Column, n: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s-]", ""), " ", "_"), 1, n)


def _bounded(terms: list[str]) -> str:
    return rf"(?<!{WORD})(?:{'|'.join(re.escape(t) for t in terms)})(?!{WORD})"


def topic(text: Column, terms: list[str] = V.AI_TERMS, variant: str = "padded") -> Column:
    """Whether a text touches a topic. Variants: ``padded`` (the text gets a blank on both ends, so
    " ai " also counts there), ``unpadded``, ``whitespace`` (any white space around such words, one
    alternation without boundaries), ``substring`` (no boundaries at all), ``hyphen`` (words with a
    blank or hyphen by substring, the others bounded)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if variant in ("padded", "unpadded"):
        body = F.concat(F.lit(" "), low, F.lit(" ")) if variant == "padded" else low
        spaced = [t for t in terms if t != t.strip()]
        plain = [t for t in terms if t == t.strip()]
        hit = low.rlike(_bounded(plain)) if plain else F.lit(False)
        for t in spaced:
            hit = hit | body.contains(t)
        return hit
    if variant == "whitespace":
        return low.rlike("|".join(re.escape(t) if t == t.strip() else rf"(?U)\s+{re.escape(t.strip())}\s+" for t in terms))
    if variant == "substring":
        return low.rlike("|".join(re.escape(t) for t in terms))
    if variant == "hyphen":
        loose = [t for t in terms if " " in t or "-" in t]
        tight = [t for t in terms if t not in loose]
        return low.rlike("|".join(re.escape(t) for t in loose)) | low.rlike(_bounded(tight))
    raise ValueError(variant)


#: One hand-written pattern over the original text, any case.
AI_PATTERN = r"(?i)artificial intelligence|machine learning|deep learning|(?<![\p{L}\p{N}_])(?:ai|llm|gpt|chatgpt)(?![\p{L}\p{N}_])"


def only_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^https?://\S+$"), F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False)) & F.coalesce(text.rlike(r"^(?U)\s+$"), F.lit(False))
