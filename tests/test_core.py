from __future__ import annotations

import json
import re
import sys

from pyspark.sql import functions as F

from quillmark.functions import names as N
from quillmark.functions import text as X
from quillmark.functions import urls as U
from quillmark.functions import verification as M
from quillmark.operators import flatten as J
from quillmark.operators import relational as R
from quillmark.operators import sentiment as S
from quillmark.sources import readers, writers
from quillmark.streaming import ingest


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("v")).first()["v"]


def apply(spark, f, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_title_case_is_that_of_python(spark):
    texts = ["o'neil", "HEWLETT-PACKARD", "3m company", "d'arcy élan", "", "ÉCOLE x"]
    assert apply(spark, X.title_case, texts) == [t.title() for t in texts]


def tokens(t):
    t = (t or "").lower()
    t = re.sub(r"http\S+|www\S+", "", t)
    return re.sub(r"[^a-z0-9\s]", " ", re.sub("[@#]", "", t)).split()


def test_tokens_and_counts_against_brute_force(spark):
    texts = ["Great #AI http://x.y/z?q=1 www.a b", None, "", "schätz\u00a0gut", "don’t @me", " \n\t ", "a" * 50_000 + " b"]
    assert apply(spark, X.tokens, texts) == [tokens(t) for t in texts]
    assert apply(spark, X.words_count, texts) == [len((t or "").split()) for t in texts]


def test_topic_variants(spark):
    texts = ["ai", "an ai day", "\u00e4ai", "Paid", "gen ai.", "x\tai\ty", None]
    assert apply(spark, lambda t: X.topic(t), texts) == [True, True, False, False, True, False, False]
    assert apply(spark, lambda t: X.topic(t, variant="unpadded"), texts) == [False, True, False, False, True, False, False]
    assert apply(spark, lambda t: X.topic(t, variant="whitespace"), texts) == [False, True, False, False, True, True, False]


def test_names(spark):
    assert apply(spark, N.clean_person, ["Tim D. Cook, MBA", "CLOUES EDWARD B II", "Robert V. Smith", None, ""]) == ["Tim D Cook", "Cloues Edward B II", "Robert Smith V", None, ""]
    assert apply(spark, N.clean_firm, ["X Co., Inc.", "ACME CORP", None]) == ["X", "Acme", None]
    assert apply(spark, N.firm_key, ["Acme,  Inc.", None]) == ["acme", ""]
    assert apply(spark, U.cut_query, ["https://e/in/A/?x=1", None]) == ["https://e/in/A", None]
    assert apply(spark, U.username, ["https://e/in/bob-1/?x", "https://e/x/y"]) == ["bob-1", "y"]
    firsts, lasts = N.name_parts(F.col("n"))
    assert one(spark, firsts, n="Bob Smith Jr")[:1] == ["bob"] and "robert" in one(spark, firsts, n="Bob Smith Jr")
    assert one(spark, lasts, n="Bob J. Smith Jr") == ["smith"]
    assert one(spark, N.firm_words(F.col("n")), n="The KLA") == [] and one(spark, N.firm_words(F.col("n")), n="KLA") == ["kla"]


def test_every_step_of_the_ladders(spark):
    rows = [(a, b, c, d) for a in (True, False) for b in (True, False) for c in (True, False) for d in (True, False)]
    df = spark.createDataFrame(rows, "f boolean, l boolean, c boolean, b boolean")
    got = df.select("*", M.general_score(*map(F.col, "flc")).alias("g"), M.director_score(*map(F.col, "flcb")).alias("d")).collect()
    for f, la, c, b, g, d in got:
        assert g == (100 if f and la and c else 90 if f and la else 70 if (f or la) and c else 60 if f or la else 30 if c else 0)
        assert d == ((100 if b and c else 95 if b else 90) if f and la else (85 if b and c else 80 if b else 60) if f or la else 30 if c else 0)


def test_scores_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "great great loss")], "id int, t string")
    wide = {r["id"]: r for r in S.score(df, "id", "t").collect()}
    assert wide[1]["polarity"] == wide[2]["polarity"] == 0.5 and wide[3]["n_positive"] == 2 and wide[3]["n_negative"] == 1
    compact = {r["id"]: r for r in S.score(df, "id", "t", variant="compact").collect()}
    assert compact[1]["sentiment_ratio"] == 0.0
    words = spark.createDataFrame([("Great", 2009, 0), ("loss", 0, 2011), (None, 1, 1)], "Word string, Positive int, Negative int")
    own = {r["word"]: (r["positive"], r["negative"], r["litigious"]) for r in S.load_lexicon(words).collect()}
    assert own == {"great": (1, 0, 0), "loss": (0, 1, 0)}


def test_relational_kit(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", None), (4, None, 1), (5, None, 2)], "id int, k string, v int")
    assert {r["id"] for r in R.first_per_key(df, ["k"], F.desc_nulls_last("v"), F.asc("id")).collect()} == {2, 3, 5}
    assert {r["id"] for r in R.duplicates(df, ["k"]).collect()} == {1, 2, 4, 5}
    assert [r["n"] for r in R.null_profile(df).select(F.col("nulls").alias("n")).collect()] == [0, 2, 1]
    assert R.prefer_newer(df.where("id < 3"), df.where("id = 3"), "k").count() == 3
    assert R.submitted_prefix(df, F.col("k"), "id", 0).count() == 0
    numbered = {r["id"]: r["batch"] for r in R.batch_numbers(df, "id", 2).collect()}
    assert numbered == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    empty = df.limit(0)
    assert R.batch_numbers(empty, "id", 2).count() == 0 and R.binned(empty, F.col("v"), [0, 1]).count() == 0
    counts = spark.createDataFrame([(1, "p", 3), (2, "p", 10), (3, "p", 4)], "batch int, key string, n int")
    assert [r["kept"] for r in R.cap_guard(counts, "batch", "n", 10).orderBy("batch").collect()] == [True, True, False]
    over = spark.createDataFrame([(1, "p", 11), (2, "p", 10)], "batch int, key string, n int")
    assert [r["kept"] for r in R.cap_guard(over, "batch", "n", 10).orderBy("batch").collect()] == [True, True]
    status = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, -1), (1, 5, 1), (2, 1, 1)], "b int, i int, s int")
    assert [tuple(r) for r in R.failure_guard(status, "b", ["i"], F.col("s"), 2).collect()] == [(1, 3)]


def test_flatten_tolerates_missing_objects(spark):
    post = {"url": "u", "author": {"first_name": "A", "last_name": None}, "stats": None}
    rows = [(1, "post", json.dumps(post)), (2, "post", json.dumps([post, None, 3])), (3, "post", None), (4, "post", "<html>"), (5, "profile", json.dumps({"results": {"u-1": {"basic_info": {"firstName": "B"}, "experience": [None, {"title": "t"}]}}}))]
    raw = spark.createDataFrame(rows, "record_id long, record_kind string, payload string")
    out = J.posts(raw).where("record_id = 1").collect()
    assert len(out) == 1 and out[0]["author_name"] == "A" and out[0]["likes"] is None
    assert J.people(raw).first()["first_name"] == "B" and J.jobs(raw).first()["position"] == 2


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", 'say "x"\nnow'), (None, "a,b")], "gvkey string, t string")
    writers.write_csv(df, f"{tmp_path}/c")
    back = readers.read_csv(spark, f"{tmp_path}/c", "gvkey string, t string", missing=("NA",))
    assert {tuple(r) for r in back.collect()} == {("007", 'say "x"\nnow'), (None, "a,b")}
    assert readers.detect_column(back, ("id", "GVKEY")) == "gvkey"
    writers.write_report(df, f"{tmp_path}/r.json")
    assert len(json.load(open(f"{tmp_path}/r.json"))) == 2
    writers.write_batches(df.withColumn("i", F.monotonically_increasing_id()), f"{tmp_path}/b", "i", 1)
    assert readers.exists(spark, f"{tmp_path}/b/batch=2")


def test_stream_resumes_without_rereading(spark, tmp_path):
    def land(n):
        spark.createDataFrame([(n, "post", "{}" if n % 2 else None)], "record_id long, record_kind string, payload string").withColumn("landed_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").json(f"{tmp_path}/in")

    def run():
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/bronze", f"{tmp_path}/ledger", f"{tmp_path}/cp").awaitTermination()

    land(1)
    run()
    land(2)
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 2
    done = ingest.progress(spark, f"{tmp_path}/ledger").first()
    assert (done["batches"], done["total"], done["found"]) == (2, 2, 1)


def test_sheets_hold_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "openpyxl", None)
    writers.write_sheets({"all": spark.range(100_001), "none": spark.range(0)}, f"{tmp_path}/book")
    assert sorted(int(x) for x in (tmp_path / "book.all.csv").read_text().split()[1:]) == list(range(100_001))
    assert (tmp_path / "book.none.csv").read_text().split() == ["id"]
    assert [len(x) for x in writers._pieces(spark.range(5), 2)] == [2, 2, 1]
