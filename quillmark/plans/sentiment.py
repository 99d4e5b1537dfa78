"""Text analytics: scores, topics, text metrics and their summaries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import vocabulary as V
from quillmark.operators import relational as R
from quillmark.operators import sentiment as S
from quillmark.plans.registry import query
from quillmark.session import spread, table

_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({t},'')), 'http[^\\s\\p{{Z}}\\x85\\x0B\\x1C-\\x1F]+|www[^\\s\\p{{Z}}\\x85\\x0B\\x1C-\\x1F]+', '', 'g'), '[@#]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _scored(source: str, keys: str, text: str) -> str:
    counts = ", ".join(f"CAST(len(list_filter(t, lambda x: x IN ({_in(V.LEXICON[c])}))) AS BIGINT) AS n_{c}" for c in S.CATEGORIES)
    return f"""SELECT *, round(CASE WHEN n_words > 0 THEN n_positive * 1000.0::DOUBLE / n_words ELSE 0 END, 6) AS positive_rate, round(CASE WHEN n_words > 0 THEN n_negative * 1000.0::DOUBLE / n_words ELSE 0 END, 6) AS negative_rate,
 round(CASE WHEN n_words > 0 THEN n_uncertainty * 1000.0::DOUBLE / n_words ELSE 0 END, 6) AS uncertainty_rate, round(CASE WHEN n_words > 0 THEN (n_positive - n_negative) * 1000.0::DOUBLE / n_words ELSE 0 END, 6) AS net,
 round(CASE WHEN n_positive + n_negative > 0 THEN n_positive * 1.0::DOUBLE / (n_positive + n_negative) ELSE 0.5 END, 6) AS polarity
 FROM (SELECT {keys}, CAST(len(t) AS BIGINT) AS n_words, {counts} FROM (SELECT {keys}, {_TOKENS.format(t=text)} AS t FROM {source}))"""


_SUMMARY = """count(*) AS n, round(avg(net), 4) AS mean, round(quantile_cont(net, 0.5), 4) AS median, round(stddev_samp(net), 4) AS std, round(quantile_cont(net, 0.25), 4) AS p25, round(quantile_cont(net, 0.75), 4) AS p75,
 round(avg(CAST(net > 0 AS DOUBLE)) * 100, 4) AS pct_positive, round(avg(CAST(net < 0 AS DOUBLE)) * 100, 4) AS pct_negative, round(avg(CAST(net = 0 AS DOUBLE)) * 100, 4) AS pct_neutral"""


@query(_scored("documents", "doc_id", "text"))
def sentiment_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.score(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"""SELECT doc_id, n_words, n_positive, n_negative, n_uncertainty, round(CASE WHEN n_words > 0 THEN n_positive * 100.0::DOUBLE / n_words ELSE 0 END, 6) AS positive_pct, round(CASE WHEN n_words > 0 THEN n_negative * 100.0::DOUBLE / n_words ELSE 0 END, 6) AS negative_pct,
 round(CASE WHEN n_words > 0 THEN n_uncertainty * 100.0::DOUBLE / n_words ELSE 0 END, 6) AS uncertainty_pct, round(CASE WHEN n_words > 0 THEN (n_positive - n_negative) * 100.0::DOUBLE / n_words ELSE 0 END, 6) AS net,
 round(CASE WHEN n_words = 0 THEN 0 WHEN n_positive + n_negative > 0 THEN n_positive * 1.0::DOUBLE / (n_positive + n_negative) ELSE 0.5 END, 6) AS sentiment_ratio FROM ({_scored("documents", "doc_id", "text")})""")
def sentiment_scores_compact(spark: SparkSession, d: str) -> DataFrame:
    return S.score(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", variant="compact")


@query(f"SELECT lang, {_SUMMARY} FROM ({_scored('documents', 'doc_id, lang', 'text')}) GROUP BY lang")
def sentiment_by_language(spark: SparkSession, d: str) -> DataFrame:
    return S.score(spread(table(spark, d, "documents").select("doc_id", "lang", "text")), "doc_id", "text").groupBy("lang").agg(*S.summary())


@query(f"SELECT company_name, {_SUMMARY} FROM ({_scored('posts_combined', 'row_id, company_name', 'post_text')}) WHERE company_name <> '' GROUP BY company_name")
def sentiment_by_company(spark: SparkSession, d: str) -> DataFrame:
    posts = spread(table(spark, d, "posts_combined").where("company_name <> ''").select("row_id", "company_name", "post_text"))
    return S.score(posts, "row_id", "post_text").groupBy("company_name").agg(*S.summary())


_BY_COMPANY = f"SELECT company_name, count(*) AS n, round(avg(net), 4) AS mean FROM ({_scored('posts_combined', 'row_id, company_name', 'post_text')}) WHERE company_name <> '' GROUP BY company_name"


@query(f"(SELECT 'top' AS side, * FROM ({_BY_COMPANY}) ORDER BY mean DESC, company_name LIMIT 10) UNION ALL (SELECT 'bottom' AS side, * FROM ({_BY_COMPANY}) ORDER BY mean, company_name LIMIT 10)")
def companies_top_bottom(spark: SparkSession, d: str) -> DataFrame:
    """The ten companies of the highest and of the lowest mean score."""
    means = sentiment_by_company(spark, d).select("company_name", "n", "mean")
    end = lambda side, *order: means.orderBy(*order, "company_name").limit(10).select(F.lit(side).alias("side"), "*")
    return end("top", F.desc("mean")).unionByName(end("bottom", F.asc("mean")))


@query(f"""SELECT row_id, net, post_text FROM (SELECT *, row_number() OVER (ORDER BY net DESC, row_id) AS k FROM (SELECT s.*, p.post_text, row_number() OVER (PARTITION BY p.post_text ORDER BY s.row_id) AS first
 FROM ({_scored('posts_combined', 'row_id', 'post_text')}) s JOIN posts_combined p USING (row_id) WHERE p.post_text IS NOT NULL) WHERE first = 1) WHERE k <= 3""")
def sentiment_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three best distinct texts; of equal texts the first row speaks."""
    posts = spread(table(spark, d, "posts_combined").where("post_text IS NOT NULL").select("row_id", "post_text"))
    once = posts.groupBy("post_text").agg(F.min("row_id").alias("row_id"))
    scored = S.score(once.withColumn("body", F.col("post_text")).select("row_id", "post_text", "body"), "row_id", "body")
    return scored.orderBy(F.desc("net"), "row_id").limit(3).select("row_id", "net", "post_text")


_W = "[\\p{L}\\p{N}_]"


def _bounded(terms: list[str], low: str) -> str:
    return f"regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(t for t in terms)})([^\\p{{L}}\\p{{N}}_]|$)')"


_LOW = "lower(coalesce(text, ''))"
_PLAIN, _SPACED = [t for t in V.AI_TERMS if t == t.strip()], [t for t in V.AI_TERMS if t != t.strip()]
_LOOSE = [t for t in V.COVID_TERMS_WIDE if " " in t or "-" in t]
_TIGHT = [t for t in V.COVID_TERMS_WIDE if t not in _LOOSE]
_U = "[\\s\\p{Z}\\x85\\x0B\\x1C-\\x1F]"
_TAGS = f"""{_bounded(_PLAIN, _LOW)} OR {' OR '.join(f"contains(' ' || {_LOW} || ' ', '{t}')" for t in _SPACED)} AS ai_padded, {_bounded(_PLAIN, _LOW)} OR {' OR '.join(f"contains({_LOW}, '{t}')" for t in _SPACED)} AS ai_unpadded,
 regexp_matches({_LOW}, '{'|'.join(t if t == t.strip() else _U + '+' + t.strip() + _U + '+' for t in V.AI_TERMS)}') AS ai_whitespace, regexp_matches({_LOW}, '{'|'.join(V.AI_TERMS)}') AS ai_substring,
 regexp_matches(coalesce(text, ''), '(?i)artificial intelligence|machine learning|deep learning|(^|[^\\p{{L}}\\p{{N}}_])(ai|llm|gpt|chatgpt)([^\\p{{L}}\\p{{N}}_]|$)') AS ai_pattern,
 {_bounded(V.COVID_TERMS, _LOW)} AS covid, regexp_matches({_LOW}, '{'|'.join(_LOOSE)}') OR {_bounded(_TIGHT, _LOW)} AS covid_wide"""


def _tagged(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.select("*", X.topic(t).alias("ai_padded"), X.topic(t, variant="unpadded").alias("ai_unpadded"), X.topic(t, variant="whitespace").alias("ai_whitespace"), X.topic(t, variant="substring").alias("ai_substring"), F.coalesce(t, F.lit("")).rlike(X.AI_PATTERN).alias("ai_pattern"), X.topic(t, V.COVID_TERMS).alias("covid"), X.topic(t, V.COVID_TERMS_WIDE, "hyphen").alias("covid_wide"))


@query(f"SELECT doc_id, {_TAGS} FROM documents")
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spread(table(spark, d, "documents").select("doc_id", "text"))).drop("text")


_TAGGED_SCORES = f"SELECT s.*, t.ai_padded, t.covid FROM ({_scored('documents', 'doc_id', 'text')}) s JOIN (SELECT doc_id, {_TAGS} FROM documents) t USING (doc_id)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS subset, {_SUMMARY} FROM ({_TAGGED_SCORES}) WHERE {w} HAVING count(*) > 0" for k, w in (("all", "true"), ("ai", "ai_padded"), ("non_ai", "NOT ai_padded"), ("covid", "covid"))))
def topic_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Score summaries of overlapping subsets, each row tagged once and counted in every subset it is in."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    tagged = docs.select("doc_id", "text", X.topic(F.col("text")).alias("ai"), X.topic(F.col("text"), V.COVID_TERMS).alias("covid"))
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("ai"), "ai").otherwise("non_ai"), F.when(F.col("covid"), "covid")))
    return S.score(tagged, "doc_id", "text").select("net", F.explode(labels).alias("subset")).groupBy("subset").agg(*S.summary())


@query(f"SELECT round(avg(CASE WHEN ai_padded THEN net END) - avg(CASE WHEN NOT ai_padded THEN net END), 4) AS difference FROM ({_TAGGED_SCORES})")
def topic_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    scored = S.score(docs.withColumn("ai", X.topic(F.col("text"))), "doc_id", "text")
    return scored.agg(F.round(F.avg(F.when(F.col("ai"), F.col("net"))) - F.avg(F.when(~F.col("ai"), F.col("net"))), 4).alias("difference"))


@query(f"SELECT s.* FROM ({_scored('documents', 'doc_id', 'text')}) s JOIN (SELECT doc_id, {_TAGS} FROM documents) t USING (doc_id) WHERE t.ai_padded")
def topic_only_scores(spark: SparkSession, d: str) -> DataFrame:
    """Only tagged rows are scored: the tag filters before the scorer, in one pass."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).where(X.topic(F.col("text")))
    return S.score(docs, "doc_id", "text")


@query(" UNION ALL ".join(f"SELECT '{t}' AS keyword, count(*) AS n_documents FROM documents WHERE contains({_LOW}, '{t}')" for t in (x.strip() for x in V.AI_TERMS)))
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents per keyword, all keywords in one pass."""
    low = F.lower(F.coalesce("text", F.lit("")))
    terms = [t.strip() for t in V.AI_TERMS]
    row = spread(table(spark, d, "documents").select("text")).agg(*[F.count_if(low.contains(t)).alias(f"k{k}") for k, t in enumerate(terms)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("keyword"), F.col(f"k{k}").alias("n_documents")) for k, t in enumerate(terms)])).alias("x")).select("x.*")


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_signs, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_U}+'), lambda w: w <> '')) AS BIGINT) AS n_words, coalesce(regexp_full_match(text, 'https?://[^\\s]+'), false) AS only_url, coalesce(regexp_full_match(text, '{_U}+'), false) AS is_blank, coalesce(length(text) > 100, false) AS is_long FROM documents")
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("n_signs"), X.words_count(t).cast("bigint").alias("n_words"), X.only_url(t).alias("only_url"), X.blank(t).alias("is_blank"), F.coalesce(F.length(t) > 100, F.lit(False)).alias("is_long"))


_EDGES = [-1, 0, 50, 100, 250, 500, 1000, 3000]


def _bins(value: str, source: str, edges: list[int]) -> str:
    case = " ".join(f"WHEN {value} > {a} AND {value} <= {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"""SELECT bin, n, round(n * 100.0::DOUBLE / total, 4) AS pct, round(CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) * 100.0::DOUBLE / total, 4) AS cumulative_pct FROM (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT CAST(CASE {case} END AS INTEGER) AS bin, count(*) AS n FROM {source} GROUP BY 1)) WHERE bin IS NOT NULL"""


@query(_bins("length(text)", "documents", _EDGES))
def text_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.binned(table(spark, d, "documents").select("text"), F.length("text"), _EDGES)


@query("SELECT lang, count(*) AS n, round(avg(w), 4) AS mean_words, round(quantile_cont(w, 0.5), 4) AS median_words, CAST(max(w) AS BIGINT) AS most_words FROM (SELECT lang, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '" + _U + "+'), lambda w: w <> '')) AS DOUBLE) AS w FROM documents) GROUP BY lang")
def word_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", X.words_count(F.col("text")).cast("double").alias("w"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.percentile("w", F.lit(0.5)), 4).alias("median_words"), F.max("w").cast("bigint").alias("most_words"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS preview FROM documents")
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 40).alias("preview"))


