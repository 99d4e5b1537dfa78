"""Names, addresses, verification and best hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import names as N
from quillmark.functions import text as X
from quillmark.functions import urls as U
from quillmark.functions import verification as M
from quillmark.functions import vocabulary as V
from quillmark.operators import relational as R
from quillmark.plans.registry import query
from quillmark.session import table

# --- SQL twins of the kernels -------------------------------------------------------------------


def _sub(x: str, patterns: list[str], to: str = "") -> str:
    return reduce(lambda c, p: f"regexp_replace({c}, '{p}', '{to}', 'gi')", patterns, x)


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda t: upper(substr(t, 1, 1)) || lower(substr(t, 2))), '')"


def _caps(x: str) -> str:
    return f"regexp_replace(CASE WHEN {x} = upper({x}) AND length({x}) > 3 THEN {_title(x)} ELSE {x} END, '''S\\b', '''s', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _person(x: str, variant: str) -> str:
    """As nested selects, each step named once."""
    suffix = f"regexp_extract({x}, '(?i){V.GENERATIONS}', 0)"
    base = _sub(f"trim({x})", V.CREDENTIALS[variant])
    bare = f"CASE WHEN sfx <> '' THEN regexp_replace(base, '{V.GENERATIONS}', '', 'gi') ELSE base END"
    if variant == "generic":
        squeezed = _squeeze("regexp_replace(regexp_replace(bare, '\\.+', ' ', 'g'), '\\s*,\\s*', ' ', 'g')")
        final, end = _caps("sq"), f"CASE WHEN {_title('sfx')} IN ('Ii', 'Iii', 'Iv') THEN upper(sfx) ELSE sfx END"
    elif variant == "full":
        squeezed, final, end = _squeeze("regexp_replace(regexp_replace(bare, '\\s*,\\s*', ' ', 'g'), '\\.+', ' ', 'g')"), "sq", "replace(sfx, '.', '')"
    else:
        squeezed, final, end = _squeeze("regexp_replace(bare, '\\s*,\\s*', ' ', 'g')"), "sq", "sfx"
    return f"""SELECT person_id, trim(CASE WHEN sfx <> '' THEN fin || ' ' || {end} ELSE fin END) AS cleaned FROM (SELECT *, {final} AS fin FROM (SELECT *, {squeezed} AS sq FROM (SELECT *, {bare} AS bare FROM (SELECT person_id, {suffix} AS sfx, {base} AS base FROM all_people))))"""


def _firm(x: str, titled: bool) -> str:
    base = _sub(f"trim({x})", V.FIRM_ENDINGS)
    return _squeeze(_caps("b") if titled else "b"), base


@query(_person("person_name", "generic"))
def person_clean_generic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.clean_person(F.col("person_name")).alias("cleaned"))


@query(_person("person_name", "full"))
def person_clean_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.clean_person(F.col("person_name"), "full").alias("cleaned"))


@query(_person("person_name", "pilot"))
def person_clean_pilot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.clean_person(F.col("person_name"), "pilot").alias("cleaned"))


@query(f"SELECT person_id, {_squeeze('b')} AS plain, {_squeeze(_caps('b'))} AS titled FROM (SELECT person_id, {_sub('trim(company_name)', V.FIRM_ENDINGS)} AS b FROM all_people)")
def company_clean(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("company_name")
    return table(spark, d, "all_people").select("person_id", N.clean_firm(c, titled=False).alias("plain"), N.clean_firm(c).alias("titled"))


@query(f"SELECT person_id, regexp_replace(regexp_replace(regexp_replace({_title('trim(person_name)')}, ' Iii$', ' III'), ' Ii$', ' II'), ' Iv$', ' IV') AS person, regexp_replace(regexp_replace({_title('trim(company_name)')}, '\\bLlc\\b', 'LLC', 'g'), '\\bLp\\b', 'LP', 'g') AS firm FROM all_people")
def sec_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.sec_person(F.col("person_name")).alias("person"), N.sec_firm(F.col("company_name")).alias("firm"))


_PKEY, _FKEY = f"coalesce(lower({_squeeze('person_name')}), '')", f"trim(regexp_replace(coalesce(lower({_squeeze('company_name')}), ''), '[,\\s]+(?:inc\\.?|corp\\.?|co\\.?|ltd\\.?|llc\\.?|l\\.p\\.)$', ''))"


@query(f"SELECT person_id, {_PKEY} AS person_key, {_FKEY} AS firm_key FROM all_people")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.person_key(F.col("person_name")).alias("person_key"), N.firm_key(F.col("company_name")).alias("firm_key"))


_CUT = "regexp_replace(split_part(profile_url, '?', 1), '/+$', '')"


@query(f"SELECT row_id, {_CUT} AS cut_query, lower(regexp_replace(split_part(split_part(regexp_replace(trim(profile_url), '/+$', ''), '?', 1), '#', 1), '/posts/([^/\\-]+)[^/]*.*$', '/in/\\1')) AS person_page, lower(regexp_replace(trim(profile_url), '/+$', '')) AS with_query, CASE WHEN regexp_extract({_CUT}, '/in/([^/]+)', 1) <> '' THEN regexp_extract({_CUT}, '/in/([^/]+)', 1) ELSE string_split({_CUT}, '/')[-1] END AS username, nullif(regexp_extract(profile_url, '(?:posts|in)/([^/?]+)', 1), '') AS profile_name FROM posts_combined")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("profile_url")
    return table(spark, d, "posts_combined").select("row_id", U.cut_query(u).alias("cut_query"), U.person_page(u).alias("person_page"), U.with_query(u).alias("with_query"), U.username(u).alias("username"), U.profile_name(u).alias("profile_name"))


@query("SELECT person_id, person_name || ' ' || company_name AS search_query, trim(coalesce(person_name, '') || ' ' || coalesce(position, '')) AS full_name, substr(replace(regexp_replace(company_name, '[^\\p{L}\\p{M}\\p{N}_\\s-]', '', 'g'), ' ', '_'), 1, 50) AS file_name FROM all_people")
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").select("person_id", N.search_query(F.col("person_name"), F.col("company_name")).alias("search_query"), N.full_name(F.col("person_name"), F.col("position")).alias("full_name"), X.safe_filename(F.col("company_name")).alias("file_name"))


def _map(lines: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in lines.items()) + "}"


_BACK: dict[str, list[str]] = {}
for _f, _ns in V.NICKNAMES.items():
    for _n in _ns:
        _BACK.setdefault(_n, []).append(_f)


def _parts(name: str) -> str:
    cleaned = f"lower({_squeeze(f'''regexp_replace({_sub(f'trim({name})', V.CREDENTIALS['parts'])}, '\\.+', ' ', 'g')''')})"
    return f"list_filter(string_split({cleaned}, ' '), lambda t: t <> '')"


_NAMED = f"""SELECT *, CASE WHEN len(p) = 0 OR p IS NULL THEN [] ELSE list_distinct_ordered END AS firsts FROM (SELECT *, [p[1]] || coalesce({_map(V.NICKNAMES)}[p[1]], []) || list_filter(coalesce({_map(_BACK)}[p[1]], []), lambda f: NOT list_contains(coalesce({_map(V.NICKNAMES)}[p[1]], []), f)) AS list_distinct_ordered, list_filter(p[2:], lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(w) for w in V.GENERATION_WORDS)})) AS rest FROM (SELECT *, {_parts('person_name')} AS p FROM all_linkedin_urls))"""


@query(f"SELECT hit_id, array_to_string(firsts, ', ') AS firsts, CASE WHEN len(rest) > 0 THEN rest[-1] ELSE '' END AS lasts FROM ({_NAMED})")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    firsts, lasts = N.name_parts(F.col("person_name"))
    return table(spark, d, "all_linkedin_urls").select("hit_id", F.array_join(firsts, ", ").alias("firsts"), F.array_join(lasts, ", ").alias("lasts"))


_ENDED = _sub("lower(coalesce(company_name, ''))", V.FIRM_ENDINGS_WIDE)
_KEEP = f"list_filter(string_split({_squeeze(f'''regexp_replace({_ENDED}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', ' ', 'g')''')}, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in V.NOISE_WORDS)}) AND NOT regexp_full_match(w, '[0-9]+') AND (length(w) > 3 OR (length(w) >= 2 AND upper(w) = trim(company_name))))"
_WORDS = f"CASE WHEN len({_KEEP}) = 0 AND length(trim(coalesce(company_name, ''))) BETWEEN 2 AND 4 THEN [lower(trim(company_name))] ELSE {_KEEP} END"


@query(f"SELECT hit_id, array_to_string({_WORDS}, ' ') AS words FROM all_linkedin_urls")
def company_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_linkedin_urls").select("hit_id", F.array_join(N.firm_words(F.col("company_name")), " ").alias("words"))


def _hits(list_: str) -> str:
    return f"list_filter({list_}, lambda w: coalesce(regexp_matches(lower(linkedin_title), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(w, '([^\\p{{L}}\\p{{N}}])', '\\\\\\1', 'g') || '([^\\p{{L}}\\p{{N}}_]|$)'), false))"


_BOARD = f"list_filter([{', '.join(repr(k) for k in V.BOARD_PHRASES)}], lambda k: coalesce(contains(lower(linkedin_title), k), false))"
_FLAGS = f"""SELECT *, {_hits('firsts')}[1] AS mf, {_hits('CASE WHEN len(rest) > 0 THEN rest[-1:] ELSE [] END')}[1] AS ml, {_hits(_WORDS)} AS fw, {_BOARD} AS bw FROM ({_NAMED})"""
_ANY = "(mf IS NOT NULL OR ml IS NOT NULL)"
_BOTH = "(mf IS NOT NULL AND ml IS NOT NULL)"
_GENERAL = f"CASE WHEN {_BOTH} AND len(fw) > 0 THEN 100 WHEN {_BOTH} THEN 90 WHEN {_ANY} AND len(fw) > 0 THEN 70 WHEN {_ANY} THEN 60 WHEN len(fw) > 0 THEN 30 ELSE 0 END"
_DIRECTOR = f"CASE WHEN {_BOTH} AND len(bw) > 0 AND len(fw) > 0 THEN 100 WHEN {_BOTH} AND len(bw) > 0 THEN 95 WHEN {_BOTH} THEN 90 WHEN {_ANY} AND len(bw) > 0 AND len(fw) > 0 THEN 85 WHEN {_ANY} AND len(bw) > 0 THEN 80 WHEN {_ANY} THEN 60 WHEN len(fw) > 0 THEN 30 ELSE 0 END"
_TYPE = f"CASE WHEN {_BOTH} THEN 'both' WHEN mf IS NOT NULL THEN 'first_name' WHEN ml IS NOT NULL THEN 'last_name' ELSE 'none' END"


def verified_hits(df: DataFrame, least: int = 80) -> DataFrame:
    """Every hit with its agreement flags, both scores and whether the director score reaches ``least``."""
    title, name, firm = F.col("linkedin_title"), F.col("person_name"), F.col("company_name")
    flags = M.name_match(name, title)
    out = df.withColumns(flags | {"firm_words": M.firm_match(firm, title), "board_words": M.board_phrases(title)})
    first, last, has_firm, board = F.col("matched_first").isNotNull(), F.col("matched_last").isNotNull(), F.size("firm_words") > 0, F.size("board_words") > 0
    out = out.withColumns({"general_score": M.general_score(first, last, has_firm), "director_score": M.director_score(first, last, has_firm, board)})
    return out.withColumn("passes", F.col("director_score") >= least)


@query(f"SELECT hit_id, mf AS matched_first, ml AS matched_last, {_TYPE} AS match_type, array_to_string(fw, ', ') AS firm_words, array_to_string(bw, ', ') AS board_words, {_GENERAL} AS general_score, {_DIRECTOR} AS director_score, {_DIRECTOR} >= 80 AS passes FROM ({_FLAGS})")
def verification_scores(spark: SparkSession, d: str) -> DataFrame:
    out = verified_hits(table(spark, d, "all_linkedin_urls"))
    return out.select("hit_id", "matched_first", "matched_last", "match_type", F.array_join("firm_words", ", ").alias("firm_words"), F.array_join("board_words", ", ").alias("board_words"), "general_score", "director_score", "passes")


@query(f"SELECT hit_id, CASE WHEN linkedin_url IS NOT NULL AND search_status = 'found' THEN s ELSE 0 END AS score, CASE WHEN linkedin_url IS NOT NULL AND search_status = 'found' AND s < 70 THEN NULL ELSE linkedin_url END AS linkedin_url, CASE WHEN linkedin_url IS NOT NULL AND search_status = 'found' AND s < 70 THEN 'filtered_low_score' ELSE search_status END AS search_status FROM (SELECT *, {_DIRECTOR} AS s FROM ({_FLAGS}))")
def verify_table(spark: SparkSession, d: str) -> DataFrame:
    """Hits without address or not found keep their defaults; low scores lose their address."""
    out = verified_hits(table(spark, d, "all_linkedin_urls"))
    judged = F.col("linkedin_url").isNotNull() & (F.coalesce("search_status", F.lit("")) == "found")
    low = judged & (F.col("director_score") < 70)
    return out.select("hit_id", F.when(judged, F.col("director_score")).otherwise(0).alias("score"), F.when(~low, F.col("linkedin_url")).alias("linkedin_url"), F.when(low, "filtered_low_score").otherwise(F.col("search_status")).alias("search_status"))


@query(f"SELECT count(*) AS n, CAST(sum(CAST({_ANY} AS INT)) AS BIGINT) AS lenient, CAST(sum(CAST({_BOTH} AS INT)) AS BIGINT) AS strict, round_even(sum(CAST({_BOTH} AS INT)) * 100.0::DOUBLE / nullif(count(*), 0), 4) AS strict_pct FROM ({_FLAGS}) WHERE linkedin_title IS NOT NULL")
def compare_modes(spark: SparkSession, d: str) -> DataFrame:
    """Hits verified if any part of the name agrees, and if both do."""
    out = verified_hits(table(spark, d, "all_linkedin_urls").where("linkedin_title IS NOT NULL"))
    return out.agg(F.count("*").alias("n"), F.count_if("name_verified").alias("lenient"), F.count_if(F.col("match_type") == "both").alias("strict"), F.bround(F.try_divide(F.count_if(F.col("match_type") == "both") * 100.0, F.count("*")), 4).alias("strict_pct"))


@query(f"SELECT CAST(least(s // 10, 9) AS BIGINT) AS band, count(*) AS n FROM (SELECT {_DIRECTOR} AS s FROM ({_FLAGS})) GROUP BY 1")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return verified_hits(table(spark, d, "all_linkedin_urls")).groupBy(F.least(F.floor(F.col("director_score") / 10), F.lit(9)).cast("bigint").alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT search_query, hit_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY s >= 80 DESC, CASE WHEN s >= 80 THEN 0 ELSE -s END, hit_id) AS k FROM (SELECT *, {_DIRECTOR} AS s FROM ({_FLAGS})) WHERE linkedin_url LIKE '%/in/%' AND search_query IS NOT NULL AND s > 0) WHERE k = 1")
def best_hits(spark: SparkSession, d: str) -> DataFrame:
    """Per query the first verified profile in rank order, else the one of the best score above 0."""
    hits = verified_hits(table(spark, d, "all_linkedin_urls").where("linkedin_url LIKE '%/in/%' AND search_query IS NOT NULL"))
    return R.best_hits(hits, "search_query", F.col("passes"), "hit_id", F.col("director_score")).select("search_query", "hit_id", F.col("director_score").alias("score"))


@query(f"SELECT hit_id, CASE WHEN {_BOTH} THEN linkedin_url END AS linkedin_url, CASE WHEN {_BOTH} THEN search_status ELSE 'unverified' END AS search_status FROM ({_FLAGS}) WHERE lower(CAST(verified AS VARCHAR)) = 'true'")
def strict_reverification(spark: SparkSession, d: str) -> DataFrame:
    """Verified hits judged again by both names; the others lose their address."""
    out = verified_hits(table(spark, d, "all_linkedin_urls").where(R.verified_true(F.col("verified"))))
    both = F.col("match_type") == "both"
    return out.select("hit_id", F.when(both, F.col("linkedin_url")).alias("linkedin_url"), F.when(both, F.col("search_status")).otherwise("unverified").alias("search_status"))


_OWNER = "regexp_matches(upper(person_name), '" + "|".join(k.replace(".", "\\.") for k in V.INSTITUTIONAL) + "')"


@query(f"SELECT hit_id, coalesce({_OWNER}, true) AS by_substring, coalesce(regexp_matches(upper(person_name), '{'|'.join(V.INSTITUTIONAL)}'), false) AS by_pattern FROM all_linkedin_urls")
def institutional_names(spark: SparkSession, d: str) -> DataFrame:
    """Two predicates that are kept apart: plain substrings (null counts as institution) and a pattern
    whose dots match any sign (null counts as person)."""
    up = F.upper("person_name")
    plain = reduce(lambda a, b: a | b, [up.contains(k) for k in V.INSTITUTIONAL])
    return table(spark, d, "all_linkedin_urls").select("hit_id", F.coalesce(plain, F.lit(True)).alias("by_substring"), F.coalesce(up.rlike("|".join(V.INSTITUTIONAL)), F.lit(False)).alias("by_pattern"))


@query("SELECT DISTINCT company_name FROM all_people WHERE contains(lower(company_name), 'foods')")
def company_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_people").where(F.lower("company_name").contains("foods")).select("company_name").distinct()


@query(f"SELECT hit_id, unnest({_map(V.NICKNAMES)}[p[1]]) AS variant FROM (SELECT hit_id, {_parts('person_name')} AS p FROM all_linkedin_urls)")
def nickname_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Short forms per first name through a join with the table of short forms (145 rows)."""
    pairs = [(k, v) for k, vs in V.NICKNAMES.items() for v in vs]
    shorts = spark.createDataFrame(pairs, "first string, variant string")
    firsts, _ = N.name_parts(F.col("person_name"))
    return table(spark, d, "all_linkedin_urls").select("hit_id", F.try_element_at(firsts, F.lit(1)).alias("first")).join(F.broadcast(shorts), "first").select("hit_id", "variant")
