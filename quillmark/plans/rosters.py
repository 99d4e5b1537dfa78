"""Membership at a date, latest links, choices by parameter, and the wider flat tables of posts and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import vocabulary as V
from quillmark.operators import flatten as J
from quillmark.operators import relational as R
from quillmark.plans.linking import _BOTH, _DIRECTOR, _FLAGS, _TYPE, verified_hits
from quillmark.plans.quality import _TS, _moment
from quillmark.plans.registry import query
from quillmark.plans.relations import _POST, _PROFILES, _cut
from quillmark.session import table

# --- filters ------------------------------------------------------------------------------------------


@query(f"SELECT row_id, year({_TS}) AS year FROM posts_combined WHERE year({_TS}) BETWEEN 2019 AND 2021")
def posts_of_years(spark: SparkSession, d: str) -> DataFrame:
    """An inclusive range of years."""
    return table(spark, d, "posts_combined").select("row_id", F.year(_moment()).cast("bigint").alias("year")).where("year BETWEEN 2019 AND 2021")


_SPANS = "SELECT company_name, person_name, min(searched_at) AS began, max(searched_at) AS ended FROM all_linkedin_urls WHERE company_name <> '' AND person_name <> '' GROUP BY 1, 2"


@query(f"SELECT company_name, person_name FROM ({_SPANS}) WHERE began <= (SELECT median_at FROM (SELECT max(searched_at) AS median_at FROM all_linkedin_urls WHERE batch_num = 1)) AND ended >= (SELECT max(searched_at) FROM all_linkedin_urls WHERE batch_num = 1)")
def members_at(spark: SparkSession, d: str) -> DataFrame:
    """Who was in a firm's list at one moment: began at or before it, and ended at or after it."""
    hits = table(spark, d, "all_linkedin_urls")
    spans = hits.where("company_name <> '' AND person_name <> ''").groupBy("company_name", "person_name").agg(F.min("searched_at").alias("began"), F.max("searched_at").alias("ended"))
    moment = hits.where("batch_num = 1").agg(F.max("searched_at").alias("moment"))
    return spans.crossJoin(F.broadcast(moment)).where("began <= moment AND ended >= moment").select("company_name", "person_name")  # one row of one moment


@query("SELECT true AS only_chiefs, person_id FROM all_people WHERE source = 'executives' AND coalesce(position = 'Chief Executive Officer', false) UNION ALL SELECT false, person_id FROM all_people WHERE source = 'executives'")
def executives(spark: SparkSession, d: str) -> DataFrame:
    """With and without an optional further predicate."""
    people = table(spark, d, "all_people").where("source = 'executives'")
    pick = lambda chiefs: R.optionally(people, F.col("position") == "Chief Executive Officer" if chiefs else None).select(F.lit(chiefs).alias("only_chiefs"), "person_id")
    return pick(True).unionByName(pick(False))


_LOOKS = "regexp_matches(upper(person_name), '" + "|".join(k.replace(".", "\\.") for k in V.INSTITUTIONAL) + "')"


@query(f"SELECT person_id FROM all_people WHERE source = 'directors' OR (coalesce(source, '') <> 'directors' AND NOT coalesce({_LOOKS}, true))")
def individual_owners(spark: SparkSession, d: str) -> DataFrame:
    """Individuals, and others whose names do not look like an institution's; a null name looks like one."""
    looks = F.coalesce(reduce(lambda a, b: a | b, [F.upper("person_name").contains(k) for k in V.INSTITUTIONAL]), F.lit(True))
    kind = F.coalesce("source", F.lit(""))
    return table(spark, d, "all_people").where((kind == "directors") | ((kind != "directors") & ~looks)).select("person_id")


_BANDS = ((100, 100), (95, 99), (90, 94), (80, 89), (70, 79), (60, 69), (30, 59), (0, 29))  # fixed values: inclusive score ranges
_BAND = "CASE " + " ".join(f"WHEN s BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in _BANDS) + " END"


@query(f"SELECT band, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM all_linkedin_urls WHERE linkedin_url IS NOT NULL), 1) AS pct FROM (SELECT {_BAND} AS band FROM (SELECT {_DIRECTOR} AS s FROM ({_FLAGS}) WHERE linkedin_url IS NOT NULL)) GROUP BY 1")
def score_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The eight inclusive ranges of the score over hits with an address; share to one digit, half to even."""
    hits = verified_hits(table(spark, d, "all_linkedin_urls").where("linkedin_url IS NOT NULL"))
    s = F.col("director_score")
    band = reduce(lambda c, r: c.when(s.between(*r), f"{r[0]}-{r[1]}"), _BANDS[1:], F.when(s.between(*_BANDS[0]), "100-100"))
    return R.shares(hits.select(band.alias("band")), "band", 1)


@query("SELECT DISTINCT company_name FROM all_people WHERE contains(lower(company_name), 'systems') OR contains(lower(company_name), 'zzz') ORDER BY company_name LIMIT 10")
def company_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """No firm holds the whole query, so the first ten that hold any of its words are suggested."""
    return R.search(table(spark, d, "all_people"), "company_name", "zzz systems")


@query("SELECT company_name FROM all_people WHERE contains(lower(company_name), 'systems') GROUP BY 1 ORDER BY company_name LIMIT 1")
def chosen_company(spark: SparkSession, d: str) -> DataFrame:
    """The match chosen by number, the first unless told otherwise."""
    return R.choose(R.search(table(spark, d, "all_people"), "company_name", "Systems"), "company_name")


# --- projections --------------------------------------------------------------------------------------


@query("SELECT person_id, coalesce(position = 'Chief Executive Officer', false) AS is_chief, coalesce(source = 'directors', false) AS on_board FROM all_people")
def role_flags(spark: SparkSession, d: str) -> DataFrame:
    """Booleans from codes; null is false."""
    return table(spark, d, "all_people").select("person_id", R.is_code("position", "Chief Executive Officer").alias("is_chief"), R.is_code("source", "directors").alias("on_board"))


@query("SELECT hit_id, person_name_clean || ' ' || company_name_clean AS search_text FROM all_linkedin_urls")
def clean_else_raw(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned columns where the table has them, else the raw ones; chosen when the plan is made."""
    hits = table(spark, d, "all_linkedin_urls")
    return hits.select("hit_id", F.concat(R.clean_or_raw(hits, "person_name"), F.lit(" "), R.clean_or_raw(hits, "company_name")).alias("search_text"))


@query("SELECT batch_num, 'profiles_' || strftime(max(searched_at), '%Y%m%d_%H%M%S') AS stem FROM all_linkedin_urls WHERE searched_at IS NOT NULL GROUP BY 1")
def stamped_names(spark: SparkSession, d: str) -> DataFrame:
    """File stems with the moment as suffix."""
    return table(spark, d, "all_linkedin_urls").where("searched_at IS NOT NULL").groupBy("batch_num").agg(R.stamped("profiles", F.max("searched_at")).alias("stem"))


# --- joins, latest rows, unions -----------------------------------------------------------------------

_LATEST = "SELECT company_name, hit_id, searched_at FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY searched_at DESC NULLS LAST, hit_id DESC) AS k FROM all_linkedin_urls WHERE company_name <> '') WHERE k = 1"


@query(_LATEST)
def latest_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the latest."""
    return R.latest_per_key(table(spark, d, "all_linkedin_urls").where("company_name <> ''"), ["company_name"], "searched_at", "hit_id").select("company_name", "hit_id", "searched_at")


@query(f"SELECT p.person_id, l.hit_id, l.searched_at FROM all_people p LEFT JOIN ({_LATEST}) l USING (company_name)")
def linked_people(spark: SparkSession, d: str) -> DataFrame:
    """Left join after the right side is made one row per key, so no row of the left is repeated."""
    right = R.latest_per_key(table(spark, d, "all_linkedin_urls").where("company_name <> ''"), ["company_name"], "searched_at", "hit_id").select("company_name", "hit_id", "searched_at")
    return table(spark, d, "all_people").select("person_id", "company_name").join(right, "company_name", "left").select("person_id", "hit_id", "searched_at")


@query("SELECT p.row_id, i.firm, i.symbol FROM posts_combined p LEFT JOIN (SELECT gvkey, first(company_name ORDER BY person_id) AS firm, first(ticker ORDER BY person_id) FILTER (ticker IS NOT NULL) AS symbol FROM all_people WHERE gvkey <> '' GROUP BY 1) i USING (gvkey)")
def company_info(spark: SparkSession, d: str) -> DataFrame:
    """Firm and symbol by the firm's key; the first row of a key speaks."""
    info = table(spark, d, "all_people").where("gvkey <> ''").groupBy("gvkey").agg(F.min_by("company_name", "person_id").alias("firm"), F.min_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("person_id"))).alias("symbol"))
    return table(spark, d, "posts_combined").select("row_id", "gvkey").join(info, "gvkey", "left").select("row_id", "firm", "symbol")


@query(f"SELECT p.row_id, h.hit_id, p.author_name AS person, p.post_url AS url, h.company_name AS firm FROM posts_combined p LEFT JOIN all_linkedin_urls h ON {_cut('p.profile_url')} = {_cut('h.linkedin_url')} AND h.match_type = 'both'")
def posts_over_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata rows per profile; a column that both sides have is the post's."""
    from quillmark.functions import urls as U

    posts = table(spark, d, "posts_combined").select(U.cut_query(F.col("profile_url")).alias("key"), "row_id", F.col("author_name").alias("person"), F.col("post_url").alias("url"))
    meta = table(spark, d, "all_linkedin_urls").where("match_type = 'both'").select(U.cut_query(F.col("linkedin_url")).alias("key"), "hit_id", F.col("person_name").alias("person"), F.col("linkedin_url").alias("url"), F.col("company_name").alias("firm"))
    return R.overriding(posts, meta, "key").select("row_id", "hit_id", "person", "url", "firm")


@query(f"SELECT search_query, hit_id, mt <> 'none' AS verified, mt AS match_type FROM (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY mt <> 'none' DESC, hit_id) AS k FROM (SELECT *, {_TYPE} AS mt FROM ({_FLAGS})) WHERE linkedin_url LIKE '%/in/%' AND search_query IS NOT NULL) WHERE k = 1")
def best_hits_generic(spark: SparkSession, d: str) -> DataFrame:
    """Per query the first verified profile in rank order, else the first profile, unverified."""
    hits = verified_hits(table(spark, d, "all_linkedin_urls").where("linkedin_url LIKE '%/in/%' AND search_query IS NOT NULL"))
    verified = F.col("match_type") != "none"
    return R.best_hits(hits.withColumn("ok", verified), "search_query", F.col("ok"), "hit_id").select("search_query", "hit_id", F.col("ok").alias("verified"), "match_type")


@query("SELECT company_name, person_name FROM all_people UNION SELECT company_name, person_name FROM all_linkedin_urls")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.union_distinct(table(spark, d, "all_people").select("company_name", "person_name"), table(spark, d, "all_linkedin_urls").select("company_name", "person_name"))


@query(f"SELECT hit_id, ({_BOTH}) AS verified, linkedin_url, match_type AS was FROM (SELECT * FROM ({_FLAGS}) WHERE batch_num % 2 = 0 UNION ALL SELECT * FROM ({_FLAGS}) WHERE batch_num % 2 <> 0)")
def restored_hits(spark: SparkSession, d: str) -> DataFrame:
    """The original batches put together again and judged anew; addresses stay, whatever the verdict."""
    hits = table(spark, d, "all_linkedin_urls")
    out = verified_hits(R.restored(hits.where("batch_num % 2 = 0"), hits.where("batch_num % 2 <> 0")).withColumn("was", F.col("match_type")))
    return out.select("hit_id", (F.col("match_type") == "both").alias("verified"), "linkedin_url", "was")


_FAILS = """WITH s AS (SELECT *, CASE WHEN search_status IN ('exception', 'error_500', 'not_found') THEN 1 ELSE -1 END AS s FROM all_linkedin_urls), i AS (SELECT *, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_num ORDER BY hit_id) AS island FROM s), r AS (SELECT batch_num, hit_id, row_number() OVER (PARTITION BY batch_num, island ORDER BY hit_id) AS k FROM i WHERE s = 1) SELECT batch_num, min(hit_id) AS hit_id FROM r WHERE k = 3 GROUP BY batch_num"""


@query(_FAILS)
def three_failures(spark: SparkSession, d: str) -> DataFrame:
    """Where a batch had failed three times in a row."""
    status = F.when(F.col("search_status").isin("exception", "error_500", "not_found"), 1).otherwise(-1)
    return R.failure_guard(table(spark, d, "all_linkedin_urls"), "batch_num", ["hit_id"], status, 3)


@query("SELECT CAST(ceil(n / 100.0) AS BIGINT) AS batches, round_even(n * 5 / 1000.0::DOUBLE, 2) AS cost, CAST(ceil(n / 100.0) * 3 AS BIGINT) AS least_minutes, CAST(ceil(n / 100.0) * 10 AS BIGINT) AS most_minutes FROM (SELECT count(DISTINCT linkedin_url) AS n FROM all_linkedin_urls)")
def scrape_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a hundred profiles, cost at five per thousand, and three to ten minutes a batch."""
    n = table(spark, d, "all_linkedin_urls").agg(F.countDistinct("linkedin_url").alias("n"))
    batches = F.ceil(F.col("n") / 100.0).cast("bigint")
    return n.select(batches.alias("batches"), F.bround(F.col("n") * 5 / F.lit(1000.0), 2).alias("cost"), (batches * 3).alias("least_minutes"), (batches * 10).alias("most_minutes"))


@query("SELECT post_type, round_even(avg(reactions_total), 2) AS mean, round_even(stddev_samp(reactions_total), 2) AS std, count(reactions_total) AS n FROM posts_combined GROUP BY 1")
def rounded_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures to two digits, half to even, as reports give them."""
    return table(spark, d, "posts_combined").groupBy("post_type").agg(F.bround(F.avg("reactions_total"), 2).alias("mean"), F.bround(F.stddev_samp("reactions_total"), 2).alias("std"), F.count("reactions_total").alias("n"))


@query("SELECT hit_id FROM all_linkedin_urls WHERE lower(CAST(verified AS VARCHAR)) = 'true' ORDER BY md5('42|' || hit_id), hit_id LIMIT 20")
def sampled_verified(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible sample of verified hits (a sampling operator)."""
    return R.sample(table(spark, d, "all_linkedin_urls").where(R.verified_true(F.col("verified"))), "hit_id", 20).select("hit_id")


# --- flat tables --------------------------------------------------------------------------------------

_T = lambda path: f"coalesce({path}, '')"
_FULL = {
    "profile_url": "p->>'profile_input'", "post_text": _T("p->>'text'"), "post_url": "p->>'url'", "post_type": _T("p->>'post_type'"), "post_date": _T("p->'posted_at'->>'date'"), "post_timestamp": "try_cast(p->'posted_at'->>'timestamp' AS BIGINT)", "post_relative": _T("p->'posted_at'->>'relative'"),
    "author_first_name": _T("p->'author'->>'first_name'"), "author_last_name": _T("p->'author'->>'last_name'"), "author_name": "trim(coalesce(p->'author'->>'first_name', '') || ' ' || coalesce(p->'author'->>'last_name', ''))", "author_headline": _T("p->'author'->>'headline'"), "author_username": _T("p->'author'->>'username'"),
    **{c: f"try_cast(p->'stats'->>'{f}' AS BIGINT)" for f, c in J.COUNTS.items()},
    "media_type": _T("p->'media'->>'type'"), "media_url": _T("p->'media'->>'url'"), "article_url": _T("p->'article'->>'url'"), "article_title": _T("p->'article'->>'title'"),
    "reshared_text": _T("p->'reshared_post'->>'text'"), "reshared_url": _T("p->'reshared_post'->>'url'"), "reshared_author": "trim(coalesce(p->'reshared_post'->'author'->>'first_name', '') || ' ' || coalesce(p->'reshared_post'->'author'->>'last_name', ''))",
    "activity_urn": _T("p->'urn'->>'activity_urn'"), "share_urn": _T("p->'urn'->>'share_urn'"), "full_urn": _T("p->>'full_urn'"),
}


@query(f"SELECT record_id, item, {', '.join(f'{v} AS {k}' for k, v in _FULL.items())} FROM ({_POST}) WHERE json_type(p) = 'OBJECT' AND p->>'url' IS NOT NULL")
def flat_posts_full(spark: SparkSession, d: str) -> DataFrame:
    """Every column of a post."""
    return J.posts(table(spark, d, "raw_records"))


_NULLS = " AND ".join(f"coalesce(json_type(p->'{k}'), '') <> 'NULL'" for k in J.NESTED)


@query(f"SELECT record_id, item, p->>'url' AS post_url FROM ({_POST}) WHERE json_type(p) = 'OBJECT' AND p->>'url' IS NOT NULL AND {_NULLS}")
def flat_posts_strict(spark: SparkSession, d: str) -> DataFrame:
    """Posts of the strict reader: a nested part may be missing, but where it is given as null the record is left out."""
    return J.strict_items(table(spark, d, "raw_records"))


@query(f"SELECT record_id, item, CAST(-1 AS INTEGER) AS post, p->>'url' AS url FROM ({_POST}) WHERE json_type(p) = 'OBJECT' AND p->>'url' IS NOT NULL AND coalesce(json_type(p->'posts'), '') <> 'ARRAY' UNION ALL SELECT record_id, item, CAST(k AS INTEGER) AS post, q->>'url' AS url FROM (SELECT record_id, item, unnest(range(len(l))) AS k, unnest(l) AS q FROM (SELECT record_id, item, CAST(p->'posts' AS JSON[]) AS l FROM ({_POST}) WHERE json_type(p) = 'OBJECT' AND json_type(p->'posts') = 'ARRAY')) WHERE json_type(q) = 'OBJECT'")
def legacy_posts(spark: SparkSession, d: str) -> DataFrame:
    """Items that are profiles with nested posts, or posts themselves."""
    return J.legacy_items(table(spark, d, "raw_records"))


def _first(*paths: str) -> str:
    return f"coalesce({', '.join(f'nullif({p}, {chr(39) * 2})' for p in paths)}, '')"


_B = "p->'basic_info'"
_PERSON = {
    "first_name": _first(f"{_B}->>'first_name'", f"{_B}->>'firstName'"), "last_name": _first(f"{_B}->>'last_name'", f"{_B}->>'lastName'"), "headline": _first(f"{_B}->>'headline'", "p->>'headline'"), "summary": _first(f"{_B}->>'summary'", "p->>'summary'", "p->>'about'"),
    "location": _first(f"{_B}->'location'->>'full'"), "location_city": _first(f"{_B}->'location'->>'city'"), "location_country": _first(f"{_B}->'location'->>'country'"), "industry": _first(f"{_B}->>'industry'", "p->>'industry'"),
    "connections": _first(f"{_B}->>'connections'", "p->>'connections'", "p->>'connectionsCount'"), "followers": _first(f"{_B}->>'followers'", "p->>'followers'", "p->>'followersCount'"), "profile_picture": _first(f"{_B}->>'profile_picture'", "p->>'profilePicture'", "p->>'profile_picture'"),
}


@query(f"SELECT record_id, username, {', '.join(f'{v} AS {k}' for k, v in _PERSON.items())} FROM ({_PROFILES}) WHERE json_type(p) = 'OBJECT'")
def profile_people(spark: SparkSession, d: str) -> DataFrame:
    """Every column of a profile."""
    return J.people(table(spark, d, "raw_records"))


def _list(field: str, columns: dict[str, str]) -> str:
    of = f"SELECT record_id, username, unnest(range(len(l))) AS k, unnest(l) AS j FROM (SELECT record_id, username, CAST(p->'{field}' AS JSON[]) AS l FROM ({_PROFILES}) WHERE json_type(p) = 'OBJECT' AND json_type(p->'{field}') = 'ARRAY')"
    return f"SELECT record_id, username, CAST(k + 1 AS INTEGER) AS position, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM ({of}) WHERE json_type(j) = 'OBJECT'"


_JOB = {"title": _first("j->>'title'", "j->>'jobTitle'"), "company": _first("j->>'company'", "j->>'companyName'"), "company_url": _first("j->>'companyUrl'", "j->>'company_url'", "j->>'companyLinkedinUrl'"), "duration": _first("j->>'duration'"), "date_range": _first("j->>'dateRange'", "j->>'date_range'"), "location": _first("CASE WHEN json_type(j->'location') = 'VARCHAR' THEN j->>'location' END", "j->'location'->>'full'", "j->'location'->>'city'"), "description": _first("j->>'description'")}
_SCHOOL = {"school": _first("j->>'school'", "j->>'schoolName'", "j->>'institution'"), "degree": _first("j->>'degree'", "j->>'degreeName'"), "field_of_study": _first("j->>'fieldOfStudy'", "j->>'field_of_study'"), "date_range": _first("j->>'dateRange'", "j->>'date_range'"), "description": _first("j->>'description'")}


@query(_list("experience", _JOB))
def profile_positions(spark: SparkSession, d: str) -> DataFrame:
    return J.jobs(table(spark, d, "raw_records"))


@query(_list("education", _SCHOOL))
def profile_education(spark: SparkSession, d: str) -> DataFrame:
    return J.schools(table(spark, d, "raw_records"))


_USERS = "SELECT record_id, unnest(CAST(payload::JSON->'failedUsernames' AS VARCHAR[])) AS username FROM raw_records WHERE record_kind = 'profile' AND json_valid(payload) AND json_type(payload::JSON->'results') = 'OBJECT' AND json_type(payload::JSON->'failedUsernames') = 'ARRAY'"


@query(f"SELECT record_id, username, 'failed' AS reason FROM ({_USERS}) WHERE username IS NOT NULL")
def failed_users(spark: SparkSession, d: str) -> DataFrame:
    return J.failed(table(spark, d, "raw_records"))


@query("SELECT CASE WHEN json_type(j) <> 'OBJECT' THEN 'unknown' WHEN json_type(j->'results') = 'OBJECT' THEN 'wrapper' WHEN (j->'basic_info') IS NOT NULL OR (j->'experience') IS NOT NULL OR (j->'education') IS NOT NULL OR (j->'firstName') IS NOT NULL OR (j->'first_name') IS NOT NULL OR (j->'headline') IS NOT NULL THEN 'flat' ELSE 'unknown' END AS shape, count(*) AS n FROM (SELECT payload::JSON AS j FROM raw_records WHERE record_kind = 'profile' AND json_valid(payload)) GROUP BY 1")
def profile_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How many profile records are wrappers, flat profiles or neither; what can't be read is left out."""
    return J.shapes(table(spark, d, "raw_records"))
