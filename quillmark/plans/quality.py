"""Quality checks, reports and activity figures over posts, hits and people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import relational as R
from quillmark.operators.flatten import literal_date
from quillmark.operators.rejects import POST_COLUMNS
from quillmark.plans.registry import query
from quillmark.session import table

PARTS = ("likes", "celebrates", "supports", "loves", "insights", "funnys")


def _long(row: DataFrame) -> DataFrame:
    """One row of numbers as (metric, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")


def _long_sql(pairs: dict[str, str], source: str) -> str:
    inner = ", ".join(f"{v} AS {k}" for k, v in pairs.items())
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({k} AS DOUBLE) AS value FROM (SELECT {inner} FROM {source})" for k in pairs)


@query("SELECT \"column\", kind FROM (VALUES " + ", ".join(f"('{c}', 'expected')" for c in POST_COLUMNS) + ", ('row_id', 'extra'), ('collected_at', 'extra')) t(\"column\", kind)")
def schema_check(spark: SparkSession, d: str) -> DataFrame:
    """Expected, missing and extra columns."""
    have = table(spark, d, "posts_combined").columns
    rows = [(c, "expected" if c in have else "missing") for c in POST_COLUMNS] + [(c, "extra") for c in have if c not in POST_COLUMNS]
    return spark.createDataFrame(rows, "column string, kind string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round_even(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 4) AS pct FROM posts_combined" for c in ("row_id", *POST_COLUMNS, "collected_at")))
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.null_profile(table(spark, d, "posts_combined"))


@query("SELECT post_type, count(*) AS n, round_even(count(*) FILTER (coalesce(post_text, '') = '') * 100.0::DOUBLE / count(*), 4) AS pct_without_text FROM posts_combined GROUP BY post_type")
def null_rate_by_type(spark: SparkSession, d: str) -> DataFrame:
    empty = F.count_if(F.coalesce("post_text", F.lit("")) == "")
    return table(spark, d, "posts_combined").groupBy("post_type").agg(F.count("*").alias("n"), F.bround(empty * 100.0 / F.count("*"), 4).alias("pct_without_text"))


@query("SELECT post_type, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS pct FROM (SELECT post_type, count(*) AS n FROM posts_combined GROUP BY 1)")
def post_type_shares(spark: SparkSession, d: str) -> DataFrame:
    return R.shares(table(spark, d, "posts_combined"), "post_type")


_KEY = [c for c in POST_COLUMNS]


@query("SELECT count(*) AS n_rows, count(DISTINCT post_url) AS posts_distinct, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM posts_combined GROUP BY " + ", ".join(_KEY) + " HAVING count(*) > 1)) AS rows_repeated_exactly, (SELECT count(*) FROM (SELECT post_url FROM posts_combined WHERE post_url IS NOT NULL GROUP BY post_url, company_name HAVING count(*) > 1)) AS repeated_at_one_company FROM posts_combined")
def duplicate_checks(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts_combined")
    exact = posts.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("rows_repeated_exactly"))
    same = posts.where("post_url IS NOT NULL").groupBy("post_url", "company_name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_at_one_company"))
    base = posts.agg(F.count("*").alias("n_rows"), F.countDistinct("post_url").alias("posts_distinct"))
    return base.crossJoin(exact).crossJoin(same)  # three frames of one row each


def _moment(c: str = "post_date") -> Column:
    shaped = F.col(c).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(shaped, F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


_TS = "CASE WHEN regexp_full_match(post_date, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN try_cast(post_date AS TIMESTAMP) END"
_DATES = {"n": "count(*)", "unreadable": f"count(*) FILTER (post_date <> '' AND ({_TS}) IS NULL)", "missing": "count(*) FILTER (coalesce(post_date, '') = '')", "before_2003": f"count(*) FILTER (({_TS}) < TIMESTAMP '2003-01-01')", "after_collection": f"count(*) FILTER (({_TS}) > collected_at)"}


@query(_long_sql(_DATES, "posts_combined"))
def date_checks(spark: SparkSession, d: str) -> DataFrame:
    t = _moment()
    return _long(table(spark, d, "posts_combined").agg(F.count("*").alias("n"), F.count_if((F.col("post_date") != "") & t.isNull()).alias("unreadable"), F.count_if(F.coalesce("post_date", F.lit("")) == "").alias("missing"), F.count_if(t < F.lit("2003-01-01").cast("timestamp")).alias("before_2003"), F.count_if(t > F.col("collected_at")).alias("after_collection")))


_SUM = " + ".join(f"coalesce({p}, 0)" for p in PARTS)
_ENGAGE = {"negative": "count(*) FILTER (reactions_total < 0)", "zero": "count(*) FILTER (reactions_total = 0)", "missing": "count(*) FILTER (reactions_total IS NULL)", "mismatch": f"count(*) FILTER (abs(reactions_total - ({_SUM})) > 0)", "largest_gap": f"max(abs(reactions_total - ({_SUM})))", "p99": "quantile_cont(CAST(reactions_total AS DOUBLE), 0.99)", "p999": "quantile_cont(CAST(reactions_total AS DOUBLE), 0.999)", "most": "max(reactions_total)"}


@query(_long_sql(_ENGAGE, "posts_combined"))
def engagement_checks(spark: SparkSession, d: str) -> DataFrame:
    """Totals against the sum of their parts, odd values and the far end."""
    total = F.col("reactions_total")
    gap = F.abs(total - reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in PARTS]))
    return _long(table(spark, d, "posts_combined").agg(F.count_if(total < 0).alias("negative"), F.count_if(total == 0).alias("zero"), F.count_if(total.isNull()).alias("missing"), F.count_if(gap > 0).alias("mismatch"), F.max(gap).alias("largest_gap"), F.percentile(total.cast("double"), F.lit(0.99)).alias("p99"), F.percentile(total.cast("double"), F.lit(0.999)).alias("p999"), F.max(total).alias("most")))


@query("SELECT post_type, count(*) AS n, round_even(avg(reactions_total), 4) AS mean, round_even(quantile_cont(CAST(reactions_total AS DOUBLE), 0.5), 4) AS median, CAST(sum(coalesce(reactions_total, 0) + coalesce(comments, 0) + coalesce(reposts, 0)) AS BIGINT) AS engagement_reactions, CAST(sum(coalesce(likes, 0) + coalesce(comments, 0) + coalesce(reposts, 0)) AS BIGINT) AS engagement_likes FROM posts_combined GROUP BY post_type")
def engagement_by_type(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, d, "posts_combined").groupBy("post_type").agg(F.count("*").alias("n"), F.bround(F.avg("reactions_total"), 4).alias("mean"), F.bround(F.percentile(F.col("reactions_total").cast("double"), F.lit(0.5)), 4).alias("median"), F.sum(z("reactions_total") + z("comments") + z("reposts")).alias("engagement_reactions"), F.sum(z("likes") + z("comments") + z("reposts")).alias("engagement_likes"))


@query(_long_sql({"gvkey_missing": "count(*) FILTER (coalesce(gvkey, '') = '')", "gvkey_distinct": "count(DISTINCT gvkey)", "execid_missing": "count(*) FILTER (coalesce(execid, '') = '')", "tickers": "count(DISTINCT ticker)", "profiles": "count(DISTINCT profile_url)"}, "posts_combined"))
def identifier_checks(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    return _long(table(spark, d, "posts_combined").agg(none("gvkey").alias("gvkey_missing"), F.countDistinct("gvkey").alias("gvkey_distinct"), none("execid").alias("execid_missing"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("profile_url").alias("profiles")))


@query("SELECT gvkey, count(DISTINCT ticker) AS n_tickers, count(DISTINCT company_name) AS n_names FROM posts_combined WHERE gvkey <> '' GROUP BY gvkey HAVING count(DISTINCT ticker) > 1 OR count(DISTINCT company_name) > 1")
def ambiguous_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts_combined").where("gvkey <> ''").groupBy("gvkey").agg(F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("company_name").alias("n_names")).where("n_tickers > 1 OR n_names > 1")


@query("SELECT count(*) AS n_profiles, round_even(avg(n), 4) AS mean, round_even(quantile_cont(CAST(n AS DOUBLE), 0.5), 4) AS median, max(n) AS most, min(n) AS least, count(*) FILTER (n > 20) AS over_20 FROM (SELECT profile_url, count(DISTINCT post_url) AS n FROM posts_combined WHERE profile_url IS NOT NULL GROUP BY 1)")
def posts_per_profile(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "posts_combined").where("profile_url IS NOT NULL").groupBy("profile_url").agg(F.countDistinct("post_url").alias("n"))
    return per.agg(F.count("*").alias("n_profiles"), F.bround(F.avg("n"), 4).alias("mean"), F.bround(F.percentile(F.col("n").cast("double"), F.lit(0.5)), 4).alias("median"), F.max("n").alias("most"), F.min("n").alias("least"), F.count_if(F.col("n") > 20).alias("over_20"))


@query(f"SELECT strftime({_TS}, '%Y-%m') AS month, year({_TS}) AS year, count(*) AS n FROM posts_combined WHERE ({_TS}) IS NOT NULL GROUP BY 1, 2")
def posts_by_month(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts_combined").select(_moment().alias("t")).where("t IS NOT NULL")
    return posts.groupBy(F.date_format("t", "yyyy-MM").alias("month"), F.year("t").cast("bigint").alias("year")).agg(F.count("*").alias("n"))


@query(f"SELECT dayname({_TS}) AS weekday, count(*) AS n FROM posts_combined WHERE ({_TS}) IS NOT NULL GROUP BY 1")
def posts_by_weekday(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()])
    posts = table(spark, d, "posts_combined").select(_moment().alias("t")).where("t IS NOT NULL")
    return posts.groupBy(F.element_at(names, F.dayofweek("t")).alias("weekday")).agg(F.count("*").alias("n"))


@query(f"SELECT profile_url, n, floor(span / 86400) AS days, round_even(n * 1.0::DOUBLE / nullif(floor(span / 86400), 0), 6) AS per_day FROM (SELECT profile_url, count(*) AS n, CAST(epoch(max({_TS})) - epoch(min({_TS})) AS DOUBLE) AS span FROM posts_combined WHERE profile_url IS NOT NULL AND ({_TS}) IS NOT NULL GROUP BY 1)")
def activity_span(spark: SparkSession, d: str) -> DataFrame:
    """Whole days between first and last post (of the full interval, not of calendar dates), and posts per day."""
    posts = table(spark, d, "posts_combined").select("profile_url", _moment().alias("t")).where("profile_url IS NOT NULL AND t IS NOT NULL")
    span = F.unix_timestamp(F.max("t")) - F.unix_timestamp(F.min("t"))
    out = posts.groupBy("profile_url").agg(F.count("*").alias("n"), F.floor(span / 86400).cast("double").alias("days"))
    return out.withColumn("per_day", F.bround(F.try_divide(F.col("n") * F.lit(1.0), F.col("days")), 6))


@query("SELECT record_id, '2020-01-0' || (record_id % 9 + 1) || ' 10:00:00' AS plain, CAST('2020-01-0' || (record_id % 9 + 1) || ' 10:00:00' AS TIMESTAMP) AS moment FROM raw_records")
def literal_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates delivered as dict literals in a text cell."""
    plain = F.concat(F.lit("2020-01-0"), (F.col("record_id") % 9 + 1).cast("string"), F.lit(" 10:00:00"))
    cell = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("{'date': '"), plain, F.lit("', 'relative': '2w'}"))).otherwise(plain)
    return table(spark, d, "raw_records").select("record_id", plain.alias("plain"), literal_date(cell).alias("moment"))


@query("SELECT count(*) AS n, round_even(avg(reactions_total), 4) AS mean, round_even(stddev_samp(reactions_total), 4) AS std, min(reactions_total) AS least, round_even(quantile_cont(CAST(reactions_total AS DOUBLE), 0.25), 4) AS p25, round_even(quantile_cont(CAST(reactions_total AS DOUBLE), 0.5), 4) AS p50, round_even(quantile_cont(CAST(reactions_total AS DOUBLE), 0.75), 4) AS p75, max(reactions_total) AS most FROM posts_combined WHERE reactions_total IS NOT NULL")
def describe_reactions(spark: SparkSession, d: str) -> DataFrame:
    v, x = F.col("reactions_total"), F.col("reactions_total").cast("double")
    q = lambda p, n: F.bround(F.percentile(x, F.lit(p)), 4).alias(n)
    return table(spark, d, "posts_combined").where("reactions_total IS NOT NULL").agg(F.count("*").alias("n"), F.bround(F.avg(v), 4).alias("mean"), F.bround(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("least"), q(0.25, "p25"), q(0.5, "p50"), q(0.75, "p75"), F.max(v).alias("most"))


@query("SELECT row_id, reactions_total FROM posts_combined WHERE reactions_total IS NOT NULL ORDER BY reactions_total DESC, row_id LIMIT 25")
def top_posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts_combined").where("reactions_total IS NOT NULL").select("row_id", "reactions_total").orderBy(F.desc("reactions_total"), "row_id").limit(25)


@query("SELECT count(*) FILTER (profile_url IS NULL AND post_url IS NULL AND post_text IS NULL) AS placeholders, count(*) FILTER (contains(coalesce(profile_url, ''), 'example.com/in/')) AS with_profile, count(*) FILTER (trim(coalesce(post_text, '')) <> '') AS with_text FROM posts_combined")
def placeholder_rows(spark: SparkSession, d: str) -> DataFrame:
    none = F.col("profile_url").isNull() & F.col("post_url").isNull() & F.col("post_text").isNull()
    return table(spark, d, "posts_combined").agg(F.count_if(none).alias("placeholders"), F.count_if(F.coalesce("profile_url", F.lit("")).contains("example.com/in/")).alias("with_profile"), F.count_if(F.trim(F.coalesce("post_text", F.lit(""))) != "").alias("with_text"))


# --- URL discovery ------------------------------------------------------------------------------------


@query("SELECT search_status, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM all_linkedin_urls), 4) AS pct FROM all_linkedin_urls GROUP BY 1")
def search_status_shares(spark: SparkSession, d: str) -> DataFrame:
    return R.shares(table(spark, d, "all_linkedin_urls"), "search_status")


_SIMPLE = "CASE WHEN contains(source, '|') THEN 'several' WHEN contains(source, 'director') THEN 'directors' WHEN contains(source, 'exec') THEN 'executives' WHEN contains(source, 'block') THEN 'blockholders' ELSE 'other' END"


@query(f"SELECT {_SIMPLE} AS source, count(*) AS n, count(linkedin_url) AS found, count(*) FILTER (verified) AS verified, round_even(count(linkedin_url) * 100.0::DOUBLE / count(*), 4) AS found_pct, round_even(count(*) FILTER (verified) * 100.0::DOUBLE / nullif(count(linkedin_url), 0), 4) AS verified_pct FROM all_linkedin_urls GROUP BY 1")
def discovery_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    simple = F.when(s.contains("|"), "several").when(s.contains("director"), "directors").when(s.contains("exec"), "executives").when(s.contains("block"), "blockholders").otherwise("other")
    return table(spark, d, "all_linkedin_urls").groupBy(simple.alias("source")).agg(F.count("*").alias("n"), F.count("linkedin_url").alias("found"), F.count_if("verified").alias("verified"), F.bround(F.count("linkedin_url") * 100.0 / F.count("*"), 4).alias("found_pct"), F.bround(F.try_divide(F.count_if("verified") * 100.0, F.count("linkedin_url")), 4).alias("verified_pct"))


@query("SELECT match_type, count(*) AS n FROM all_linkedin_urls WHERE verified GROUP BY match_type")
def match_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_linkedin_urls").where("verified").groupBy("match_type").agg(F.count("*").alias("n"))


_PER = "SELECT company_name, count(DISTINCT linkedin_url) AS n FROM all_linkedin_urls WHERE verified AND company_name <> '' GROUP BY 1"


@query(f"SELECT company_name, n FROM ({_PER}) WHERE n > (SELECT quantile_cont(CAST(n AS DOUBLE), 0.95) FROM ({_PER}))")
def outlier_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies with more verified profiles than 95 in 100."""
    per = table(spark, d, "all_linkedin_urls").where("verified AND company_name <> ''").groupBy("company_name").agg(F.countDistinct("linkedin_url").alias("n"))
    line = per.agg(F.percentile(F.col("n").cast("double"), F.lit(0.95)).alias("line"))
    return per.crossJoin(F.broadcast(line)).where("n > line").select("company_name", "n")  # one row


_BINS = [0, 1, 2, 3, 5, 10, 20, 50]


@query("SELECT bin, n, round_even(n * 100.0::DOUBLE / total, 4) AS pct, round_even(CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) * 100.0::DOUBLE / total, 4) AS cumulative_pct FROM (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT CAST(CASE " + " ".join(f"WHEN n > {a} AND n <= {b} THEN {k}" for k, (a, b) in enumerate(zip(_BINS, _BINS[1:], strict=False))) + f" END AS INTEGER) AS bin, count(*) AS n FROM ({_PER}) GROUP BY 1)) WHERE bin IS NOT NULL")
def profiles_per_company(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "all_linkedin_urls").where("verified AND company_name <> ''").groupBy("company_name").agg(F.countDistinct("linkedin_url").alias("v"))
    return R.binned(per, F.col("v"), _BINS)


_MERGE = {"n_rows": "count(*)", "companies": "count(DISTINCT company_name)", "people": "count(DISTINCT person_name)", "profiles": "count(DISTINCT profile_url)", "posts": "count(DISTINCT post_url)", "first_batch_rows": "count(*) FILTER (row_id % 2 = 0)"}


@query(_long_sql(_MERGE, "posts_combined"))
def merge_report(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x: F.countDistinct(x)
    return _long(table(spark, d, "posts_combined").agg(F.count("*").alias("n_rows"), c("company_name").alias("companies"), c("person_name").alias("people"), c("profile_url").alias("profiles"), c("post_url").alias("posts"), F.count_if(F.col("row_id") % 2 == 0).alias("first_batch_rows")))


@query("SELECT company_name, count(*) AS n_rows, count(DISTINCT post_url) AS n_posts, count(DISTINCT person_name) AS n_people, round_even(avg(reactions_total), 4) AS mean_reactions FROM posts_combined WHERE company_name <> '' GROUP BY 1 ORDER BY n_posts DESC, company_name LIMIT 15")
def top_companies(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "posts_combined").where("company_name <> ''").groupBy("company_name").agg(F.count("*").alias("n_rows"), F.countDistinct("post_url").alias("n_posts"), F.countDistinct("person_name").alias("n_people"), F.bround(F.avg("reactions_total"), 4).alias("mean_reactions"))
    return per.orderBy(F.desc("n_posts"), "company_name").limit(15)


@query("SELECT w.label, count(DISTINCT p.post_url) AS n_posts, round_even(avg(p.reactions_total), 4) AS mean_reactions FROM (VALUES ('David', 'group 1'), ('Helena', 'group 2')) w(first, label) JOIN posts_combined p ON split_part(p.person_name, ' ', 1) = w.first GROUP BY 1")
def selected_people(spark: SparkSession, d: str) -> DataFrame:
    """Extract for a table of chosen people (a parameter), with a summary."""
    chosen = spark.createDataFrame([("David", "group 1"), ("Helena", "group 2")], "first string, label string")
    posts = table(spark, d, "posts_combined").withColumn("first", F.substring_index("person_name", " ", 1))
    return posts.join(F.broadcast(chosen), "first").groupBy("label").agg(F.countDistinct("post_url").alias("n_posts"), F.bround(F.avg("reactions_total"), 4).alias("mean_reactions"))


@query("SELECT batch_num, count(*) AS n, count(DISTINCT person_name) AS n_people, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_requests, round_even(count(*) * 0.005::DOUBLE, 4) AS cost FROM all_linkedin_urls GROUP BY 1")
def batch_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a hundred and cost at five per thousand, per batch."""
    return table(spark, d, "all_linkedin_urls").groupBy("batch_num").agg(F.count("*").alias("n"), F.countDistinct("person_name").alias("n_people"), F.ceil(F.count("*") / 100.0).cast("bigint").alias("n_requests"), F.bround(F.count("*") * 0.005, 4).alias("cost"))


@query("SELECT row_id, CASE WHEN n = 20 THEN 'CAPPED' ELSE '' END AS flag FROM (SELECT row_id, count(*) OVER (PARTITION BY profile_url) AS n FROM posts_combined WHERE profile_url IS NOT NULL)")
def capped_flags(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts_combined").where("profile_url IS NOT NULL").select("row_id", "profile_url")
    n = posts.groupBy("profile_url").agg(F.count("*").alias("n"))
    return posts.join(n, "profile_url").select("row_id", F.when(F.col("n") == 20, "CAPPED").otherwise("").alias("flag"))


