from __future__ import annotations

import json

from quillmark.operators import nested


def paths(value) -> set[str]:
    named = (n for n in nested.walk("1", value) if n[8] and (n[3] in nested.OBJECT_KEYS and n[6] is None or n[3] in nested.LIST_KEYS and n[6] is not None))
    return {n[5] for n in named}


def test_paths_of_every_kind():
    value = {
        "stats": {"like": 1}, "posted_at": "{'date': 'x'}", "reshared_post": {"stats": '{"like": 2}', "reshared_post": {"posted_at": {}}},
        "results": {"some-user": {"experience": [None, "text", {"title": "a", "roles": {"title": "b"}}, {}, "{'title': 'c'}"]}},
    }
    assert paths(value) == {"stats", "posted_at", "reshared_post", "reshared_post.stats", "reshared_post.reshared_post", "results.some-user.experience[2]", "results.some-user.experience[2].roles[0]", "results.some-user.experience[4]"}
    assert paths([[], {"stats": {"a": 1}}]) == {"[1].stats"}
    assert paths({"experience": {"title": "x"}}) == {"experience[0]"}
    assert paths({"stats": [], "posted_at": "2020", "roles": ["{}"]}) == set()


def test_depth_has_no_limit():
    value: dict = {"a": 1}
    for _ in range(5000):
        value = {"reshared_post": value}
    assert len(paths(value)) == 5000
    deep = '{"reshared_post":' * 20_000 + '{"a": [1, -2.5e1, null, true, "x\\u00e9"]}' + "}" * 20_000
    ok, root = nested.parse_payload(deep)
    assert ok and len(paths(root)) == 20_000
    assert nested.parse_payload(deep[:-1]) == (False, None) and nested.parse_payload(deep + "x") == (False, None)
    assert nested.parse_payload('{"stats": {"like": ' + "7" * 5001 + "}}")[1]["stats"]["like"] == "7" * 5001


def test_deep_parser_equals_the_library():
    good = [{"a": [1, {"b": [], "c": {}}, "x,]}\n"], "d": -1.5e-3, "e": None}, [], {}, "t", 0, [[[1]], [True, False]]]
    assert all(nested.parse_deep(json.dumps(v, indent=1)) == v for v in good)
    for bad in ("", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "nul", '"a', "{1:2}", "NaN", "01", "[1]]", "1 1"):
        assert nested.parse_payload(bad) == (False, None)
        try:
            nested.parse_deep(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_parents_ordinals_and_odd_payloads(spark):
    good = json.dumps({"experience": [{"title": "a", "roles": [{"n": 1}, {"n": 2}]}], "stats": {"like": 3}})
    rows = [(1, good, "x"), (1, good, "x"), (2, None, "x"), (3, "", "x"), (4, "{broken", "x"), (5, '{"stats": {"like": NaN}}', "x"), (None, '{"stats": {"like": 2.5}}', "x"), (6, '"\\ud800"', "x")]
    df = spark.createDataFrame(rows, "record_id long, payload string, node_key string")
    out = nested.nodes(df)
    found = {(r["record_id"], r["path"]) for r in nested.found_paths(df).collect()}
    assert found == {(1, "experience[0]"), (1, "experience[0].roles[0]"), (1, "experience[0].roles[1]"), (1, "stats"), (None, "stats")}
    by_path = {r["path"]: r for r in out.where("record_id = 1").collect()}
    assert by_path["experience[0].roles[1]"]["parent_key"] == by_path["experience[0]"]["node_key"]
    assert by_path["experience[0].roles[1]"]["ordinal"] == 1 and by_path["experience[0]"]["parent_key"] == by_path[""]["node_key"]
    tables = nested.child_tables(out)
    assert sorted(r["like"] for r in tables["stats"].collect()) == [2.5, 3.0, 3.0]
    assert sorted(r["like"] for r in nested.table_of(df, "stats").collect()) == [2.5, 3.0, 3.0]
    assert nested.nodes(df.limit(0)).count() == 0 and nested.found_paths(df.limit(0)).count() == 0
    assert nested.table_of(df, "nobody").count() == 0


def test_every_list_has_its_table_and_names_for_keys_fold(spark):
    rows = [(k, json.dumps({"results": {f"user-{k}": {"education": [{"school": "s"}, {"school": None}], "skills": ["a", 2, None], "grid": [[1, 2], [3]]}}})) for k in range(80)]
    out = nested.folded(nested.nodes(spark.createDataFrame(rows, "record_id long, payload string")))
    tables = nested.child_tables(out)
    assert tables["education"].count() == 160 and tables["education"].where("school = 's'").count() == 80
    assert sorted(r["value"] or "" for r in tables["skills"].where("record_id = 3").collect()) == ["", "2", "a"]
    assert [r["value"] for r in tables["grid[]"].where("record_id = 3").orderBy("path").collect()] == [1, 2, 3]
    members = out.where("kind = 'results.*'")
    assert members.count() == 80 and members.where("name = 'user-7'").count() == 1 and out.where("kind LIKE 'user%'").count() == 0
