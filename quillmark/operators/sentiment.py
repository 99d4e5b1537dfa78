"""Dictionary sentiment: category counts per text and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import vocabulary as V
from quillmark.functions.text import tokens

CATEGORIES = ("positive", "negative", "uncertainty", "litigious", "constraining")


def load_lexicon(df: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(word, one 0/1 column per category) of a word-list table: a member where the column is > 0.
    Missing category columns count as empty; words are lower-cased; null words drop."""
    cols = {c.lower(): c for c in df.columns}
    flag = lambda c: F.coalesce((F.col(cols[c]) > 0).cast("int"), F.lit(0)) if c in cols else F.lit(0)
    return df.where(F.col(cols["word"]).isNotNull()).groupBy(F.lower(F.col(cols["word"])).alias("word")).agg(*[F.max(flag(c)).alias(c) for c in categories])


def default_lexicon(df: DataFrame) -> DataFrame:
    rows: dict[str, list[int]] = {}
    for k, c in enumerate(CATEGORIES):
        for w in V.LEXICON[c]:
            rows.setdefault(w, [0] * len(CATEGORIES))[k] = 1
    return df.sparkSession.createDataFrame([(w, *f) for w, f in sorted(rows.items())], "word string, " + ", ".join(f"{c} int" for c in CATEGORIES))


def _counter(words: list[str], toks: Column) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(*words))).cast("bigint")


def _ratio(a: Column, n: Column, scale: float) -> Column:
    return F.when(n > 0, a * F.lit(scale) / n).otherwise(F.lit(0.0))


def score(df: DataFrame, key: str, text: str, lexicon: DataFrame | None = None, variant: str = "wide") -> DataFrame:
    """Category counts and ratios per row, in one narrow pass.

    ``wide``: five categories, ratios per thousand words, net, polarity (0.5 where neither positive
    nor negative words occur). ``compact``: three categories, ratios per hundred, sentiment ratio 0 for
    texts without words. The lexicon (a word list of bounded size) is collected and becomes part of
    the expression, so texts are neither exploded nor shuffled. Null and empty texts score zero."""
    toks = tokens(F.col(text))
    lists = V.LEXICON
    if lexicon is not None:
        lists = {c: [r["word"] for r in lexicon.where(F.col(c) > 0).select("word").collect()] for c in CATEGORIES}
    n = F.size("__t").cast("bigint")
    base = df.withColumn("__t", toks).withColumn("n_words", n)
    used = CATEGORIES if variant == "wide" else CATEGORIES[:3]
    base = base.withColumns({f"n_{c}": _counter(lists[c], F.col("__t")) for c in used}).drop("__t")
    pos, neg, n = F.col("n_positive"), F.col("n_negative"), F.col("n_words")
    if variant == "wide":
        extra = {"positive_rate": _ratio(pos, n, 1000.0), "negative_rate": _ratio(neg, n, 1000.0), "uncertainty_rate": _ratio(F.col("n_uncertainty"), n, 1000.0), "net": _ratio(pos - neg, n, 1000.0), "polarity": F.when(pos + neg > 0, pos * F.lit(1.0) / (pos + neg)).otherwise(F.lit(0.5))}
    else:
        extra = {"positive_pct": _ratio(pos, n, 100.0), "negative_pct": _ratio(neg, n, 100.0), "uncertainty_pct": _ratio(F.col("n_uncertainty"), n, 100.0), "net": _ratio(pos - neg, n, 100.0), "sentiment_ratio": F.when(n == 0, 0.0).when(pos + neg > 0, pos * F.lit(1.0) / (pos + neg)).otherwise(F.lit(0.5))}
    return base.withColumns({k: F.round(v, 6) for k, v in extra.items()}).select(*[c for c in df.columns if c != text or c == key], "n_words", *[f"n_{c}" for c in used], *extra)


def summary(value: str = "net") -> list[Column]:
    """Count, mean, median, deviation, quartiles and shares of a score; nulls for an empty group."""
    v = F.col(value)
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 4)
    return [F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp(v), 4).alias("std"), F.round(F.percentile(v, F.lit(0.25)), 4).alias("p25"), F.round(F.percentile(v, F.lit(0.75)), 4).alias("p75"), share(v > 0).alias("pct_positive"), share(v < 0).alias("pct_negative"), share(v == 0).alias("pct_neutral")]
