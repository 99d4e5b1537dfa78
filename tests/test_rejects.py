from __future__ import annotations

import csv
import io
import re
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pyarrow as pa

from quillmark.operators import rejects

GRAMMAR = re.compile(r'(?:"(?:[^"]|"")*+"|[^",]*+)(?:,(?:"(?:[^"]|"")*+"|[^",]*+))*+')
SPEC = rejects.RecordSpec(("a", "b", "c"), {"a": rejects.Rule("digits"), "b": rejects.Rule("timestamp")})


def brute(text: str | None) -> str | None:
    if text is None or text == "":
        return "column_count"
    if not re.fullmatch(r'(?:"(?:[^"]|"")*+"|[^",\r\n]*+)(?:(?:,|\r\n|\r|\n)(?:"(?:[^"]|"")*+"|[^",\r\n]*+))*+', text):
        return "quoting"
    rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    bare = not GRAMMAR.fullmatch(text) or len(rows) != 1
    if bare or len(rows[0]) != 3:
        return "column_count"
    a, b, _ = rows[0]
    if not re.fullmatch("[0-9]*", a):
        return "bad_value"
    if b:
        try:
            assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", b, re.A)
            datetime.strptime(b, "%Y-%m-%d %H:%M:%S")
        except (ValueError, AssertionError):
            return "bad_value"
    return None


CASES = ["1,2020-02-29 10:00:00,x", "1,2021-02-29 10:00:00,x", "1,2020-13-01 10:00:00,x", "1,2020-12-01 24:00:00,x", ",,", '1,,"a\nb"', '1,,a"b', '1,,"ab', '1,,"a"b', '1,,"a""b"', "1,,x\n2,,y", "1,,", "1,,x,y", "x,,", "", None, "٣,,", '"1","","x"', ' "1",,x', "1,0001-01-01 00:00:00,", "1,,\n"]


def test_cases_against_brute_force():
    out = rejects.classify(pa.array(CASES), SPEC)
    got = out["reason"].to_pylist()
    assert got == [brute(c) for c in CASES]
    assert out["c"].to_pylist()[5] == "a\nb" and out["c"].to_pylist()[9] == 'a"b'


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='1a",\n é', max_size=12), max_size=8))
def test_any_text_is_judged_like_brute_force(texts):
    assert rejects.classify(pa.array(texts, pa.string()), SPEC)["reason"].to_pylist() == [brute(t) for t in texts]


def test_null_empty_long_and_clashing_columns(spark):
    long = "1,,\"" + "x, y\n" * 200_000 + '"'
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, long, "q"), (3, long, "q"), (None, "7,,z", "q")], "line_id long, line_text string, reason string")
    out = rejects.load_records(df, SPEC)
    rows = {(r["line_id"], r["reason"]) for r in out.collect()}
    assert rows == {(1, "column_count"), (2, "column_count"), (3, None), (None, None)}
    assert "in_reason" in out.columns and out.count() == 5
    assert rejects.load_records(df.limit(0), SPEC).count() == 0
