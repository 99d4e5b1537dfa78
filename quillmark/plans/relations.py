"""People tables, post tables, joins, firsts, overlaps and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import names as N
from quillmark.functions import urls as U
from quillmark.operators import flatten as J
from quillmark.operators import relational as R
from quillmark.plans.registry import query
from quillmark.session import table

_CUT = "regexp_replace(split_part({u}, '?', 1), '/+$', '')"


def _cut(u: str) -> str:
    return _CUT.format(u=u)


# --- people ----------------------------------------------------------------------------------------


@query("SELECT company_name, person_name, person_id, position FROM (SELECT *, row_number() OVER (PARTITION BY company_name, person_name ORDER BY execid DESC NULLS LAST, person_id) AS k FROM all_people) WHERE k = 1")
def latest_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """One row per firm and person, the one of the highest id."""
    return R.first_per_key(table(spark, d, "all_people"), ["company_name", "person_name"], F.desc_nulls_last("execid"), F.asc("person_id")).select("company_name", "person_name", "person_id", "position")


@query("SELECT DISTINCT company_name, gvkey, ticker FROM all_people")
def companies_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("company_name", "gvkey", "ticker").distinct()


_KEYED = "SELECT *, coalesce(lower(trim(regexp_replace(person_name, '\\s+', ' ', 'g'))), '') AS pk, trim(regexp_replace(coalesce(lower(trim(regexp_replace(company_name, '\\s+', ' ', 'g'))), ''), '[,\\s]+(?:inc\\.?|corp\\.?|co\\.?|ltd\\.?|llc\\.?|l\\.p\\.)$', '')) AS ck, CASE WHEN contains(source, 'directors') THEN 1 WHEN contains(source, 'executives') THEN 2 ELSE 3 END AS prio FROM all_people"


@query(f"SELECT ck, pk, first(person_name ORDER BY prio, person_id) AS person_name, first(position ORDER BY prio, person_id) AS position, string_agg(DISTINCT source, '|' ORDER BY source) AS source, first(gvkey ORDER BY prio, person_id) FILTER (gvkey IS NOT NULL) AS gvkey, first(execid ORDER BY prio, person_id) FILTER (execid IS NOT NULL) AS execid FROM ({_KEYED}) WHERE pk <> '' AND ck <> '' GROUP BY ck, pk")
def people_merged(spark: SparkSession, d: str) -> DataFrame:
    """One row per person and firm over all sources: base row by source priority, sources joined,
    ids from the first source that has them."""
    keyed = table(spark, d, "all_people").withColumns({"pk": N.person_key(F.col("person_name")), "ck": N.firm_key(F.col("company_name"))})
    priority = F.when(F.col("source").contains("directors"), 1).when(F.col("source").contains("executives"), 2).otherwise(3)
    return R.priority_merge(keyed, ["ck", "pk"], priority, "person_id", "source", ["gvkey", "execid"], ["person_name", "position"])


@query(f"SELECT pk, count(DISTINCT source) AS n_sources, count(DISTINCT ck) AS n_boards FROM ({_KEYED}) WHERE pk <> '' GROUP BY pk HAVING count(DISTINCT ck) > 1 OR count(DISTINCT source) > 1")
def people_on_several_boards(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "all_people").select("source", N.person_key(F.col("person_name")).alias("pk"), N.firm_key(F.col("company_name")).alias("ck")).where("pk <> ''")
    return keyed.groupBy("pk").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("ck").alias("n_boards")).where("n_boards > 1 OR n_sources > 1")


@query("SELECT CASE WHEN contains(source, '|') THEN 'several' WHEN source = 'directors' THEN 'board' WHEN source = 'executives' THEN 'management' ELSE 'owner' END AS kind, count(*) AS n, count(execid) AS with_execid FROM all_people GROUP BY 1")
def source_statistics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("source").contains("|"), "several").when(F.col("source") == "directors", "board").when(F.col("source") == "executives", "management").otherwise("owner")
    return table(spark, d, "all_people").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("execid").alias("with_execid"))


@query("SELECT company_name, person_id FROM all_people WHERE contains(coalesce(position, ''), 'Director') AND gvkey BETWEEN '000010' AND '000200'")
def directors_in_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").where(F.coalesce("position", F.lit("")).contains("Director") & F.col("gvkey").between("000010", "000200")).select("company_name", "person_id")


# --- posts: firsts, duplicates, order ------------------------------------------------------------------


@query("SELECT row_id, post_url FROM (SELECT row_id, post_url, row_number() OVER (PARTITION BY post_url ORDER BY row_id) AS k FROM posts_combined WHERE post_url IS NOT NULL) WHERE k = 1")
def first_post_per_url(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts_combined").where("post_url IS NOT NULL")
    return posts.groupBy("post_url").agg(F.min("row_id").alias("row_id"))


@query("SELECT row_id, post_text FROM (SELECT row_id, post_text, count(*) OVER (PARTITION BY post_text) AS n FROM posts_combined WHERE post_text IS NOT NULL) WHERE n > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(table(spark, d, "posts_combined").where("post_text IS NOT NULL").select("row_id", "post_text"), ["post_text"])


@query("SELECT n_rows, n_distinct, n_rows - n_distinct AS n_repeats, round_even(n_rows * 1.0::DOUBLE / n_distinct, 6) AS ratio FROM (SELECT count(*) AS n_rows, count(DISTINCT post_url) AS n_distinct FROM posts_combined WHERE post_url IS NOT NULL)")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    row = table(spark, d, "posts_combined").where("post_url IS NOT NULL").agg(F.count("*").alias("n_rows"), F.countDistinct("post_url").alias("n_distinct"))
    return row.select("*", (F.col("n_rows") - F.col("n_distinct")).alias("n_repeats"), F.bround(F.col("n_rows") * 1.0 / F.col("n_distinct"), 6).alias("ratio"))


@query(f"SELECT key, first_seen FROM (SELECT {_cut('profile_url')} AS key, min(row_id) AS first_seen FROM posts_combined WHERE profile_url IS NOT NULL GROUP BY 1) ORDER BY first_seen LIMIT 100")
def submitted_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred distinct profiles in landing order."""
    return R.submitted_prefix(table(spark, d, "posts_combined"), U.cut_query(F.col("profile_url")), "row_id", 100)


@query(f"SELECT DISTINCT {_cut('linkedin_url')} AS key FROM all_linkedin_urls WHERE linkedin_url IS NOT NULL AND {_cut('linkedin_url')} NOT IN (SELECT {_cut('profile_url')} FROM posts_combined WHERE profile_url IS NOT NULL)")
def remaining_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Found profiles that no post has come from yet."""
    found = table(spark, d, "all_linkedin_urls").select(U.cut_query(F.col("linkedin_url")).alias("key")).where("key IS NOT NULL").distinct()
    done = table(spark, d, "posts_combined").select(U.cut_query(F.col("profile_url")).alias("key")).where("key IS NOT NULL").distinct()
    return found.join(done, "key", "left_anti")


@query(f"SELECT key, n FROM (SELECT {_cut('profile_url')} AS key, count(DISTINCT post_url) AS n FROM posts_combined WHERE profile_url IS NOT NULL GROUP BY 1) WHERE n >= 20")
def capped_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles at or over the page cap, to be queued again."""
    posts = table(spark, d, "posts_combined").select(U.cut_query(F.col("profile_url")).alias("key"), "post_url").where("key IS NOT NULL")
    return posts.groupBy("key").agg(F.countDistinct("post_url").alias("n")).where("n >= 20")


@query("SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 500) + 1 AS BIGINT) AS batch FROM posts_combined")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return R.batch_numbers(table(spark, d, "posts_combined").select("row_id"), "row_id", 500).select("row_id", F.col("batch").cast("bigint").alias("batch"))




@query("WITH t AS (SELECT row_id, " + _cut("profile_url") + " AS key, row_id % 2 = 0 AS newer FROM posts_combined) SELECT row_id, key FROM t WHERE newer OR key IS NULL OR key NOT IN (SELECT key FROM t WHERE newer AND key IS NOT NULL)")
def prefer_newer(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping collections: profiles of the newer one replace those of the older."""
    rows = table(spark, d, "posts_combined").select("row_id", U.cut_query(F.col("profile_url")).alias("key"))
    return R.prefer_newer(rows.where("row_id % 2 <> 0"), rows.where("row_id % 2 = 0"), "key")


@query(f"SELECT count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT key, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT {_cut('linkedin_url')} AS key, true AS a, false AS b FROM all_linkedin_urls UNION ALL SELECT {_cut('profile_url')}, false, true FROM posts_combined) WHERE key IS NOT NULL GROUP BY key)")
def profile_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.overlap(table(spark, d, "all_linkedin_urls").select(U.cut_query(F.col("linkedin_url")).alias("key")), table(spark, d, "posts_combined").select(U.cut_query(F.col("profile_url")).alias("key")), "key")


@query(f"SELECT p.row_id, h.hit_id, h.company_name AS board FROM posts_combined p LEFT JOIN all_linkedin_urls h ON {_cut('p.profile_url')} = {_cut('h.linkedin_url')} AND h.match_type = 'both'")
def metadata_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Posts with every board seat of their profile; posts without a match stay."""
    hits = table(spark, d, "all_linkedin_urls").where("match_type = 'both'").select(U.cut_query(F.col("linkedin_url")).alias("key"), "hit_id", F.col("company_name").alias("board"))
    posts = table(spark, d, "posts_combined").select("row_id", U.cut_query(F.col("profile_url")).alias("key"))
    return posts.join(hits, "key", "left").select("row_id", "hit_id", "board")


@query(f"SELECT h.hit_id, h.person_name FROM all_linkedin_urls h WHERE h.linkedin_url IS NOT NULL AND lower(CAST(h.verified AS VARCHAR)) = 'true' AND NOT EXISTS (SELECT 1 FROM posts_combined p WHERE {_cut('p.profile_url')} = {_cut('h.linkedin_url')} AND p.post_url <> '')")
def verified_without_posts(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "all_linkedin_urls").where(F.col("linkedin_url").isNotNull() & R.verified_true(F.col("verified"))).select("hit_id", "person_name", U.cut_query(F.col("linkedin_url")).alias("key"))
    posts = table(spark, d, "posts_combined").where("post_url <> ''").select(U.cut_query(F.col("profile_url")).alias("key")).distinct()
    return hits.join(posts, "key", "left_anti").select("hit_id", "person_name")


@query(f"SELECT DISTINCT p.row_id FROM posts_combined p WHERE regexp_extract({_cut('profile_url')}, '/in/([^/]+)', 1) <> '' AND lower(regexp_extract({_cut('profile_url')}, '/in/([^/]+)', 1)) IN (SELECT lower(regexp_extract({_cut('linkedin_url')}, '/in/([^/]+)', 1)) FROM all_linkedin_urls WHERE linkedin_url IS NOT NULL)")
def requested_authors(spark: SparkSession, d: str) -> DataFrame:
    """Only posts whose author was asked for."""
    asked = table(spark, d, "all_linkedin_urls").select(F.lower(U.username(F.col("linkedin_url"))).alias("user")).where("user IS NOT NULL").distinct()
    return table(spark, d, "posts_combined").where(F.regexp_extract("profile_url", "/in/([^/]+)", 1) != "").select("row_id", F.lower(U.username(F.col("profile_url"))).alias("user")).join(asked, "user", "left_semi").select("row_id")


@query(f"SELECT key, arg_min(author_name, row_id) FILTER (author_name IS NOT NULL) AS author_name, count(*) AS n FROM (SELECT *, {_cut('profile_url')} AS key FROM posts_combined) WHERE key IS NOT NULL GROUP BY key ORDER BY n DESC, key LIMIT 20")
def most_active_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Top profiles with the first author name seen."""
    posts = table(spark, d, "posts_combined").select(U.cut_query(F.col("profile_url")).alias("key"), "author_name", "row_id").where("key IS NOT NULL")
    first = F.min_by("author_name", F.when(F.col("author_name").isNotNull(), F.col("row_id")))
    return posts.groupBy("key").agg(first.alias("author_name"), F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)


_COUNTS = f"SELECT CAST(row_id // 200 AS BIGINT) AS batch, {_cut('profile_url')} AS key, count(*) AS n FROM posts_combined GROUP BY 1, 2"


@query(f"""WITH per AS (SELECT batch, max(n) AS most, max(CASE WHEN n = 10 THEN 1 ELSE 0 END) AS at_cap FROM ({_COUNTS}) GROUP BY batch), r AS (SELECT batch, most, at_cap = 1 AND max(most) OVER (ORDER BY batch) <= 10 AS stop FROM per) SELECT batch, most, stop, coalesce(batch <= (SELECT min(batch) FROM r WHERE stop), true) AS kept FROM r""")
def cap_guard(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "posts_combined").groupBy(F.expr("row_id div 200").alias("batch"), U.cut_query(F.col("profile_url")).alias("key")).agg(F.count("*").alias("n"))
    return R.cap_guard(counts, "batch", "n", 10)


@query("""WITH s AS (SELECT *, CASE WHEN search_status IN ('exception', 'error_500') THEN 1 WHEN search_status = 'not_found' THEN 0 ELSE -1 END AS s FROM all_linkedin_urls), i AS (SELECT *, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_num ORDER BY hit_id) AS island FROM s WHERE s <> 0), r AS (SELECT batch_num, hit_id, row_number() OVER (PARTITION BY batch_num, island ORDER BY hit_id) AS k FROM i WHERE s = 1) SELECT batch_num, min(hit_id) AS hit_id FROM r WHERE k = 2 GROUP BY batch_num""")
def failure_guard(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("search_status").isin("exception", "error_500"), 1).when(F.col("search_status") == "not_found", 0).otherwise(-1)
    return R.failure_guard(table(spark, d, "all_linkedin_urls"), "batch_num", ["hit_id"], status, 2)


@query("SELECT l.batch_num, l.found, l.total, coalesce(h.n, 0) AS rows_seen, coalesce(h.found, 0) AS found_seen, round_even(coalesce(h.found, 0) * 100.0::DOUBLE / nullif(h.n, 0), 4) AS found_pct FROM batch_ledger l LEFT JOIN (SELECT batch_num, count(*) AS n, count(*) FILTER (search_status = 'found') AS found FROM all_linkedin_urls GROUP BY batch_num) h USING (batch_num)")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "all_linkedin_urls").groupBy("batch_num").agg(F.count("*").alias("n"), F.count_if(F.col("search_status") == "found").alias("f"))
    ledger = table(spark, d, "batch_ledger").select("batch_num", "found", "total")
    return ledger.join(seen, "batch_num", "left").select("batch_num", "found", "total", F.coalesce("n", F.lit(0)).alias("rows_seen"), F.coalesce("f", F.lit(0)).alias("found_seen"), F.bround(F.coalesce("f", F.lit(0)) * 100.0 / F.nullif(F.col("n"), F.lit(0)), 4).alias("found_pct"))


@query("SELECT hit_id, person_name, linkedin_title FROM all_linkedin_urls WHERE lower(CAST(verified AS VARCHAR)) = 'true' ORDER BY md5('42|' || hit_id), hit_id LIMIT 20")
def sampled_hits(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible sample in hash order (a sampling operator)."""
    return R.sample(table(spark, d, "all_linkedin_urls").where(R.verified_true(F.col("verified"))), "hit_id", 20).select("hit_id", "person_name", "linkedin_title")


# --- JSON ------------------------------------------------------------------------------------------------

_POST = "SELECT record_id, 0 AS item, payload::JSON AS p FROM raw_records WHERE record_kind = 'post' AND json_valid(payload) AND json_type(payload::JSON) = 'OBJECT' UNION ALL SELECT record_id, unnest(range(len(l)))::INT AS item, unnest(l) AS p FROM (SELECT record_id, CAST(payload::JSON AS JSON[]) AS l FROM raw_records WHERE record_kind = 'post' AND json_valid(payload) AND json_type(payload::JSON) = 'ARRAY')"


@query(f"SELECT record_id, item, p->>'profile_input' AS profile_url, coalesce(p->>'text', '') AS post_text, p->>'url' AS post_url, coalesce(p->>'post_type', '') AS post_type, trim(coalesce(p->'author'->>'first_name', '') || ' ' || coalesce(p->'author'->>'last_name', '')) AS author_name FROM ({_POST}) WHERE json_type(p) = 'OBJECT' AND p->>'url' IS NOT NULL")
def flat_posts(spark: SparkSession, d: str) -> DataFrame:
    return J.posts(table(spark, d, "raw_records")).select("record_id", "item", "profile_url", "post_text", "post_url", "post_type", "author_name")


_PROFILES = "SELECT record_id, unnest(json_keys(r)) AS username, unnest(list_transform(json_keys(r), lambda k: json_extract(r, '$.\"' || k || '\"'))) AS p FROM (SELECT record_id, payload::JSON->'results' AS r FROM raw_records WHERE record_kind = 'profile' AND json_valid(payload) AND json_type(payload::JSON) = 'OBJECT') WHERE json_type(r) = 'OBJECT' UNION ALL SELECT record_id, payload::JSON->>'username', payload::JSON FROM raw_records WHERE record_kind = 'profile' AND json_valid(payload) AND json_type(payload::JSON->'basic_info') = 'OBJECT'"


@query(f"SELECT record_id, username, coalesce(nullif(p->'basic_info'->>'first_name', ''), nullif(p->'basic_info'->>'firstName', ''), '') AS first_name, coalesce(nullif(p->'basic_info'->>'last_name', ''), nullif(p->'basic_info'->>'lastName', ''), '') AS last_name, coalesce(p->'basic_info'->>'headline', '') AS headline FROM ({_PROFILES}) WHERE json_type(p) = 'OBJECT'")
def flat_profiles(spark: SparkSession, d: str) -> DataFrame:
    return J.people(table(spark, d, "raw_records")).select("record_id", "username", "first_name", "last_name", "headline")


@query(f"SELECT username, coalesce(url, 'https://example.com/in/' || username) AS url FROM (SELECT DISTINCT username FROM ({_PROFILES}) WHERE username IS NOT NULL AND json_type(p) = 'OBJECT') LEFT JOIN (SELECT lower(regexp_extract({_cut('linkedin_url')}, '/in/([^/]+)', 1)) AS username, min({_cut('linkedin_url')}) AS url FROM all_linkedin_urls WHERE linkedin_url IS NOT NULL GROUP BY 1) USING (username)")
def profile_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The address a profile was asked for under, else one made of its user name."""
    users = J.people(table(spark, d, "raw_records")).select("username").where("username IS NOT NULL").distinct()
    asked = table(spark, d, "all_linkedin_urls").where("linkedin_url IS NOT NULL").select(F.lower(U.username(F.col("linkedin_url"))).alias("username"), U.cut_query(F.col("linkedin_url")).alias("url")).groupBy("username").agg(F.min("url").alias("url"))
    return users.join(asked, "username", "left").select("username", F.coalesce("url", F.concat(F.lit("https://example.com/in/"), "username")).alias("url"))


