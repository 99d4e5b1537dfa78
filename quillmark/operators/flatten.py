"""Landed JSON of posts and profiles as typed flat tables; tolerant of missing and null objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nested parts of a post.
NESTED = ("posted_at", "author", "stats", "media", "article", "reshared_post", "urn")
#: Counts of a post and the columns they become.
COUNTS = {"total_reactions": "reactions_total", "like": "likes", "comments": "comments", "reposts": "reposts", "celebrate": "celebrates", "support": "supports", "love": "loves", "insight": "insights", "funny": "funnys"}
MEMBER = "struct<first_name:string,last_name:string,headline:string,username:string>"
STATS = "struct<" + ",".join(f"{c}:string" for c in COUNTS) + ">"
WHEN = "struct<date:string,timestamp:bigint,relative:string>"
POST = f"profile_input string, text string, url string, post_type string, full_urn string, posted_at {WHEN}, author {MEMBER}, stats {STATS}, urn struct<activity_urn:string,share_urn:string>, media struct<type:string,url:string>, article struct<url:string,title:string>, reshared_post struct<text:string,url:string,author:{MEMBER}>"
PLACE = "struct<full:string,city:string,country:string>"
JOB = "struct<title:string,jobTitle:string,company:string,companyName:string,companyUrl:string,company_url:string,companyLinkedinUrl:string,duration:string,date_range:string,dateRange:string,location:string,description:string>"
SCHOOL = "struct<school:string,schoolName:string,institution:string,degree:string,degreeName:string,fieldOfStudy:string,field_of_study:string,dateRange:string,date_range:string,description:string>"
BASIC = f"struct<first_name:string,firstName:string,last_name:string,lastName:string,headline:string,summary:string,industry:string,connections:string,followers:string,profile_picture:string,location:{PLACE}>"
TOP = "headline:string,summary:string,about:string,industry:string,connections:string,connectionsCount:string,followers:string,followersCount:string,profilePicture:string,profile_picture:string"
PROFILE = f"struct<basic_info:{BASIC},experience:array<string>,education:array<string>,username:string,{TOP}>"


def _text(*options: Column) -> Column:
    """First option that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def post_items(raw: DataFrame) -> DataFrame:
    """(record_id, item, post) of every post item; lists of items are exploded, foreign elements give nothing."""
    single = F.from_json("payload", f"struct<{_struct(POST)}>")
    many = F.from_json("payload", f"array<struct<{_struct(POST)}>>")
    is_list = F.coalesce(F.ltrim("payload").startswith("["), F.lit(False))
    items = F.when(is_list, many).otherwise(F.array(single))
    rows = raw.where("record_kind = 'post' AND payload IS NOT NULL").select("record_id", F.posexplode(items).alias("item", "post"))
    return rows.where("post.url IS NOT NULL")


def _struct(fields: str) -> str:
    """A DDL field list in the notation of nested types."""
    out, depth = [], 0
    for part in fields.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def posts(raw: DataFrame) -> DataFrame:
    """The flat post: one row per item, missing texts as '', missing counts as null."""
    name = lambda p: F.trim(F.concat(_text(F.col(f"{p}.first_name")), F.lit(" "), _text(F.col(f"{p}.last_name"))))
    return post_items(raw).select(
        "record_id", "item", F.col("post.profile_input").alias("profile_url"), _text(F.col("post.text")).alias("post_text"), F.col("post.url").alias("post_url"), _text(F.col("post.post_type")).alias("post_type"),
        _text(F.col("post.posted_at.date")).alias("post_date"), F.col("post.posted_at.timestamp").alias("post_timestamp"), _text(F.col("post.posted_at.relative")).alias("post_relative"), _text(F.col("post.author.first_name")).alias("author_first_name"), _text(F.col("post.author.last_name")).alias("author_last_name"), _text(F.col("post.author.username")).alias("author_username"), name("post.author").alias("author_name"), _text(F.col("post.author.headline")).alias("author_headline"),
        *[F.col(f"post.stats.{f}").try_cast("bigint").alias(c) for f, c in COUNTS.items()], _text(F.col("post.media.type")).alias("media_type"), _text(F.col("post.media.url")).alias("media_url"), _text(F.col("post.article.url")).alias("article_url"), _text(F.col("post.article.title")).alias("article_title"),
        _text(F.col("post.reshared_post.text")).alias("reshared_text"), _text(F.col("post.reshared_post.url")).alias("reshared_url"), name("post.reshared_post.author").alias("reshared_author"),
        _text(F.col("post.urn.activity_urn")).alias("activity_urn"), _text(F.col("post.urn.share_urn")).alias("share_urn"), _text(F.col("post.full_urn")).alias("full_urn"),
    )


def profiles(raw: DataFrame) -> DataFrame:
    """(record_id, username, profile): wrappers with user names as keys, and flat profiles; anything
    else gives nothing."""
    rows = raw.where("record_kind = 'profile' AND payload IS NOT NULL")
    wrapped = rows.select("record_id", F.explode(F.from_json("payload", f"struct<results:map<string,{PROFILE}>>")["results"]).alias("username", "profile"))
    flat = rows.select("record_id", F.from_json("payload", PROFILE).alias("profile")).where("profile.basic_info IS NOT NULL").select("record_id", F.col("profile.username").alias("username"), "profile")
    return wrapped.where("profile IS NOT NULL").unionByName(flat)


def people(raw: DataFrame) -> DataFrame:
    """One row per profile; a part may stand under ``basic_info`` or beside it, in either way of writing keys."""
    b = lambda *fs: [F.col(f"profile.basic_info.{f}") for f in fs]
    top = lambda *fs: [F.col(f"profile.{f}") for f in fs]
    return profiles(raw).select(
        "record_id", "username", _text(*b("first_name", "firstName")).alias("first_name"), _text(*b("last_name", "lastName")).alias("last_name"), _text(*b("headline"), *top("headline")).alias("headline"), _text(*b("summary"), *top("summary", "about")).alias("summary"),
        _text(*b("location.full")).alias("location"), _text(*b("location.city")).alias("location_city"), _text(*b("location.country")).alias("location_country"), _text(*b("industry"), *top("industry")).alias("industry"),
        _text(*b("connections"), *top("connections", "connectionsCount")).alias("connections"), _text(*b("followers"), *top("followers", "followersCount")).alias("followers"), _text(*b("profile_picture"), *top("profilePicture", "profile_picture")).alias("profile_picture"),
    )


def _entries(raw: DataFrame, field: str, schema: str) -> DataFrame:
    """(record_id, username, position, x): objects of a list with their place, from 1; other entries keep their place, but are left out."""
    rows = profiles(raw).select("record_id", "username", F.posexplode(f"profile.{field}").alias("k", "text")).where(F.col("text").startswith("{"))
    return rows.select("record_id", "username", (F.col("k") + 1).alias("position"), F.from_json("text", schema).alias("x"))


def _of(*fields: str) -> Column:
    return _text(*[F.col(f"x.{f}") for f in fields])


def jobs(raw: DataFrame) -> DataFrame:
    """One row per position held."""
    place = F.from_json("x.location", PLACE)
    where = _text(F.when(~F.col("x.location").startswith("{"), F.col("x.location")), place["full"], place["city"])
    return _entries(raw, "experience", JOB).select("record_id", "username", "position", _of("title", "jobTitle").alias("title"), _of("company", "companyName").alias("company"), _of("companyUrl", "company_url", "companyLinkedinUrl").alias("company_url"), _of("duration").alias("duration"), _of("dateRange", "date_range").alias("date_range"), where.alias("location"), _of("description").alias("description"))


def schools(raw: DataFrame) -> DataFrame:
    return _entries(raw, "education", SCHOOL).select("record_id", "username", "position", _of("school", "schoolName", "institution").alias("school"), _of("degree", "degreeName").alias("degree"), _of("fieldOfStudy", "field_of_study").alias("field_of_study"), _of("dateRange", "date_range").alias("date_range"), _of("description").alias("description"))


def _variants(raw: DataFrame, kind: str) -> DataFrame:
    return raw.where((F.col("record_kind") == kind) & F.col("payload").isNotNull()).select("record_id", F.try_parse_json("payload").alias("v")).where("v IS NOT NULL")


def failed(raw: DataFrame) -> DataFrame:
    """User names a wrapper lists as failed."""
    names = F.from_json("payload", "struct<results:map<string,string>,failedUsernames:array<string>>")
    rows = raw.where("record_kind = 'profile' AND payload IS NOT NULL").select("record_id", names.alias("p")).where("p.results IS NOT NULL")
    return rows.select("record_id", F.explode("p.failedUsernames").alias("username")).where("username IS NOT NULL").withColumn("reason", F.lit("failed"))


def shapes(raw: DataFrame) -> DataFrame:
    has = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    kind = F.schema_of_variant(F.try_variant_get("v", "$.results", "variant"))
    flat = has("basic_info") | has("experience") | has("education") | has("firstName") | has("first_name") | has("headline")
    shape = F.when(~F.schema_of_variant("v").startswith("OBJECT"), "unknown").when(kind.startswith("OBJECT"), "wrapper").when(flat, "flat").otherwise("unknown")
    return _variants(raw, "profile").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def _items(raw: DataFrame) -> DataFrame:
    """(record_id, item, v): post items as variants, lists of items exploded."""
    is_list = F.ltrim("payload").startswith("[")
    rows = raw.where("record_kind = 'post' AND payload IS NOT NULL").select("record_id", F.posexplode(F.when(is_list, F.from_json("payload", "array<string>")).otherwise(F.array("payload"))).alias("item", "text"))
    return rows.select("record_id", "item", F.try_parse_json("text").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def _url(v: str) -> Column:
    return F.try_variant_get(v, "$.url", "string")


def strict_items(raw: DataFrame) -> DataFrame:
    """(record_id, item, post_url) of posts without a nested part given as null; a missing part is none."""
    null = [F.coalesce(F.is_variant_null(F.try_variant_get("v", f"$.{k}", "variant")), F.lit(False)) for k in NESTED]
    return _items(raw).where(_url("v").isNotNull()).where(~reduce(lambda a, b: a | b, null)).select("record_id", "item", _url("v").alias("post_url"))


def legacy_items(raw: DataFrame) -> DataFrame:
    """(record_id, item, post, url): the posts nested in an item, numbered, or the item itself as post -1."""
    nested = F.try_variant_get("v", "$.posts", "array<variant>")
    rows = _items(raw).withColumn("posts", nested)
    own = rows.where("posts IS NULL").where(_url("v").isNotNull()).select("record_id", "item", F.lit(-1).alias("post"), _url("v").alias("url"))
    below = rows.where("posts IS NOT NULL").select("record_id", "item", F.posexplode("posts").alias("post", "q")).where(F.schema_of_variant("q").startswith("OBJECT"))
    return own.unionByName(below.select("record_id", "item", "post", _url("q").alias("url")))


def literal_date(cell: Column) -> Column:
    """The date of a dict literal in a text cell ({'date': '...'}), else the cell itself; bad dates are null."""
    parsed = F.from_json(cell, "date string", {"allowSingleQuotes": "true"})["date"]
    return F.try_to_timestamp(F.coalesce(F.when(cell.startswith("{"), parsed), cell))
