from __future__ import annotations

import math
from itertools import combinations

from quillmark.llm import linkage, names, variants


def test_distance_counts_swaps_and_lost_signs():
    assert names.distance("abcd", "abdc") == 1 and names.distance("abc", "abcc") == 1 and names.distance("a\ufffdc", "abc") == 0
    assert names.distance("abcdef", "uvwxyz") == 3


def test_reading_names():
    assert names.person("Keladinski, LucÃ\xada") == names.person("Dr. Lucía Keladinski, CFA") == names.Person(("lucia",), "keladinski")
    assert names.person("TORINESHOLM Helena").surname == "torinesholm"
    assert names.person("Taligamman Barbara", frozenset({"barbara"})).surname == "taligamman"
    assert names.person("D I Ellodusman") == names.Person(("d", "i"), "ellodusman")
    assert names.person("") is None and names.person("Cher") == names.Person((), "cher")
    assert names.firm("The Molorzen Company") == names.Firm("molorzen", (), "co") and names.firm("Draigquil-Services P.L.C. -CL A") == names.Firm("draigquil", ("services",), "plc")
    assert names.abbreviates("mfg", "manufacturing") and not names.abbreviates("tech", "foods")


def test_given_names():
    assert names.same_given("bob", "robert") == 2 and names.same_given("j", "jack") == 2 and names.same_given("kennth", "kenneth") == 1
    assert names.same_given("paul", "paula") == 0 and names.same_given("helen", "helena") == 0 and names.same_given("marta", "maria") == 0
    assert names.given_level(("anna", "b"), ("anna", "c")) == 0 and names.given_level((), ("anna",)) is None


def brute_cosines(pool: list[str], least: float) -> dict:
    from collections import Counter

    df = Counter(g for s in pool for g in variants.grams(s))
    v = {s: {g: n * math.sqrt(math.log((len(pool) + 1) / df[g]) + 0.1) for g, n in variants.grams(s).items()} for s in pool}
    size = {s: math.sqrt(sum(w * w for w in x.values())) for s, x in v.items()}
    pairs = {(a, b): sum(w * v[b].get(g, 0) for g, w in v[a].items()) / size[a] / size[b] for a, b in combinations(sorted(pool), 2)}
    return {p: c for p, c in pairs.items() if c >= least}


def test_sparse_join_finds_every_pair_whatever_the_lengths(spark):
    pool = "lanedtek lanedetk lanedek keladinski keladinsky keladin a ab zeligorard zeligorad merubeseau merrubeseau ann anna annan schwarz schwarzenegger kristensen kristensenholdings andersson anderssondottir papa papadopoulos anders smith smithsonian".split()
    df = spark.createDataFrame([(c,) for c in [*pool, *pool[:3]]] + [(None,), ("",)], "core string")
    for least in (0.2, 0.3, 0.5):
        got = {(r["a"], r["b"]): r["cosine"] for r in variants.sparse_cosine_join(df, least).collect()}
        want = brute_cosines(pool, least)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert ("schwarz", "schwarzenegger") in brute_cosines(pool, 0.3) and ("kristensen", "kristensenholdings") in brute_cosines(pool, 0.3)


def test_top_of_the_join(spark):
    rows = [("a", "x", 0.8), ("a", "y", 0.6), ("b", "x", 0.8), ("b", "z", 0.6), ("c", "x", 1.0), ("d", "y", 1.0), ("e", "q", 1.0)]
    top = {(r["a"], r["b"]) for r in variants.cosine_join(spark.createDataFrame(rows, "id string, feature string, w double"), 0.5, top=1).collect()}
    assert top == {("a", "c"), ("b", "c"), ("c", "a"), ("d", "a")}


def test_join_is_exact_however_meetings_are_split(spark, monkeypatch):
    pool = "lanedtek lanedetk lanedek keladinski keladinsky keladin a ab zeligorard zeligorad ann anna annan schwarz schwarzenegger kristensen kristensenholdings andersson anderssondottir anders smith smithsonian".split()
    df = spark.createDataFrame([(c,) for c in pool], "core string")
    for together, depth, block in ((2, 6, 1000), (2, 2, 2), (1, 1, 3)):
        monkeypatch.setattr(variants, "TOGETHER", together)
        monkeypatch.setattr(variants, "DEPTH", depth)
        monkeypatch.setattr(variants, "BLOCK", block)
        got = {(r["a"], r["b"]): r["cosine"] for r in variants.sparse_cosine_join(df, 0.3).collect()}
        want = brute_cosines(pool, 0.3)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_a_common_feature_alone_brings_no_vectors_together(spark, monkeypatch):
    n, met = 3000, []
    rows = [(f"v{k:04d}", f, w**0.5) for k in range(n) for f, w in (("all", 0.3), (f"ten{k // 10}", 0.3), (f"own{k}", 0.4))]
    meetings = variants._meetings
    monkeypatch.setattr(variants, "_meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    out = variants.cosine_join(spark.createDataFrame(rows, "id string, feature string, w double"), 0.5)
    got = {(r["a"], r["b"]): r["cosine"] for r in out.collect()}
    assert len(got) == n // 10 * 45 and all(a[:4] == b[:4] and abs(c - 0.6) < 1e-9 for (a, b), c in got.items())
    assert sum(r["count"] ** 2 for r in met[0].groupBy("k").count().collect()) <= 20 * n


def naive_linkage(edges: dict, least: float) -> set[frozenset]:
    clusters = {frozenset([n]) for p in edges for n in p}
    s = lambda a, b: sum(edges.get((min(x, y), max(x, y)), 0) for x in a for y in b) / (len(a) * len(b))
    while True:
        best = max(((s(a, b), sorted(map(min, (a, b)), reverse=True), a, b) for a, b in combinations(clusters, 2)), default=(0, 0, None, None), key=lambda t: (t[0], [-ord(c) for c in "".join(sorted(map(min, (t[2], t[3]))))] if t[2] else []))
        if best[0] < least:
            return {c for c in clusters if len(c) > 1}
        clusters = clusters - {best[2], best[3]} | {best[2] | best[3]}


def test_average_linkage_equals_merging_one_by_one(spark):
    edges = {("a", "b"): 0.9, ("a", "c"): 0.7, ("b", "c"): 0.65, ("c", "d"): 0.8, ("e", "f"): 0.5, ("f", "g"): 0.45, ("h", "i"): 0.3}
    got: dict = {}
    for r in variants.average_linkage(spark.createDataFrame([(*p, v) for p, v in edges.items()], "a string, b string, score double"), 0.42).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(c) for c in got.values()} == naive_linkage(edges, 0.42)
    assert variants.average_linkage(spark.createDataFrame([], "a string, b string, score double")).count() == 0


def test_linkage_of_many_rounds_ends(spark):
    edges = [(f"n{i:02d}", f"n{k:02d}", 0.99 - 0.01 * k) for k in range(1, 14) for i in range(k)]
    got = variants.average_linkage(spark.createDataFrame(edges, "a string, b string, score double"), 0.5).collect()
    assert len(got) == 14 and {r["cluster"] for r in got} == {"n00"}


def test_variants_of_one_entity(spark):
    people = ["Helena Greeneski", "Greeneski, Helena", "Helena Greenesik", "H. Greeneski", "helena greeneski", "Helen Greeneski", "Bob Grüadewell", "Robert GrÃ¼adewell", None, "", " ", "Helena Greeneski"]
    firms = ["Balepquil Industries Ltd", "Balepquil Ind", "Balepqiul Industries Limited", "Balepquil Technologies PLC", None, ""]
    rows = [(p, None, firms[k % len(firms)], "x", "y", "https://e/in/one") for k, p in enumerate(people)]
    df = spark.createDataFrame(rows, "person_name string, author_name string, company_name string, entity string, core string, profile_url string")
    got = {tuple(r) for r in variants.found(df).collect()}
    assert ("person", "Bob Grüadewell", "Robert GrÃ¼adewell") in got and ("person", "Greeneski, Helena", "Helena Greeneski") in got
    assert not any("Helen Greeneski" in r for r in got if r[1] != "H. Greeneski" and r[2] != "H. Greeneski")
    assert {r[1:] for r in got if r[0] == "company"} == {("Balepquil Ind", "Balepquil Industries Ltd"), ("Balepqiul Industries Limited", "Balepquil Ind"), ("Balepqiul Industries Limited", "Balepquil Industries Ltd")}
    assert variants.found(df.limit(0)).count() == 0


def groups(out) -> set[frozenset]:
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["entity"], set()).add(r["value"])
    return {frozenset(g) for g in got.values()}


def test_what_a_name_was_seen_with_tells_slips_from_namesakes(spark):
    rows = [("Robert Tororesholm", "u1"), ("Robert Marisesholm", "u2"), ("Agnes Balikumlund", "u3"), ("Agnes Balikumlubd", "u3"), ("Agnes Balikumlund", None), ("Agnes Bakilumlund", "u3")]
    seen = spark.createDataFrame([("person", *r) for r in rows] + [("company", "Agnes Balikumlund", "u3"), ("person", None, "u1"), ("person", " ", "u1")], "kind string, value string, context string")
    assert groups(variants.entities(seen)) == {frozenset({"Agnes Balikumlund", "Agnes Balikumlubd", "Agnes Bakilumlund"})}
    assert variants.entities(seen.limit(0)).count() == 0


def test_words_take_the_meaning_of_a_far_commoner_one(spark):
    surnames = [f"{a}{b}{c}sholm" for a in ("bal", "dor", "kel") for b in ("an", "er", "il", "om", "ut") for c in ("da", "fi", "go", "li", "mu", "ne")]
    rows = [("person", f"{g} {s.title()}") for g in ("Peter", "Wolfgang") for s in surnames] + [("person", f"Wolfgnag {s.title()}") for s in surnames[4:8]]
    rows += [("person", f"Adele {s.title()}") for s in surnames[:30]] + [("person", f"Adela {s.title()}") for s in surnames[30:36]]  # both names
    rows += [("company", f"{s} {w}") for s in surnames[:20] for w in ("Manufacturing", "Materials", "Foods")] + [("company", f"{s} {w}") for s in surnames[:2] for w in ("Mfg", "Matls", "Fds")]
    words = spark.createDataFrame(rows, "kind string, value string").mapInArrow(variants._words, "kind string, value string, word string, other string, opens boolean")
    told = {r["word"]: (r["known"], r["meant"]) for r in variants.word_meanings(words).collect()}
    assert told == {"peter": (True, None), "wolfgang": (True, None), "adele": (True, None), "adela": (True, None), "wolfgnag": (False, "wolfgang"), "mfg": (False, "manufacturing"), "matls": (False, "materials"), "fds": (False, "foods")}


HITS = "hit_id long, person_name string, company_name string, linkedin_title string, confidence string"


def test_linkage_cases(spark):
    people = [(100, "Frederick Galanisdahl", "Balalvia Foods Co", "z"), (101, "GALANISDAHL, FREDERICK", "BALALVIA FOODS CO", "z"), (102, "Amara Koritz", "Balalvia Foods Co", "z"), (103, None, "Balalvia Foods Co", "z"), (None, "", None, "z")]
    hits = [
        (1, "Freddie Galanisdahl", "Balalvia Fds", "Frederick Galanisdahl - CFO - Balalvia Foods Co | LinkedIn", ""),
        (2, None, "Balalvia Foods Co", "Frederick Galanisdahl | LinkedIn", ""), (3, "Frederick Galanisdahl", None, "F. Galanisdahl – Balalvia Foods Co", ""),
        (4, "Frederick Galanisdahl", "Balalvia Foods Co", None, ""), (5, "Frederick Galanisdahl", "Balalvia Foods Co", "Amara Koritz - CFO | LinkedIn", ""),
        (6, "Frederick Galanisdahl", "Berandra Systems Inc", "Frederick Galanisdahl | LinkedIn", ""), (7, "Frederick Galanisdahl", "Balalvia Foods Co", "Frederick G. - CFO - Bala ...", ""),
        (None, "Amara Koritz", "Balalvia Foods Co", "Koritz, Amara | LinkedIn", ""),
    ]
    h, p = spark.createDataFrame(hits, HITS), spark.createDataFrame(people, "person_id long, person_name string, company_name string, pattern string")
    got = {tuple(r) for r in linkage.found(h, p).collect()}
    assert got == {(k, q) for k in (1, 2, 3, 7) for q in (100, 101)} | {(None, 102)}
    assert linkage.found(h.limit(0), p).count() == 0 and linkage.found(h, p.limit(0)).count() == 0


def test_every_near_surname_of_a_firm_is_proposed():
    import random

    def keys(surname):
        return set(linkage.block_keys({"g": ["anna"], "m": "", "s": [surname], "f": ["balalvia|foods|co"], "k": []}))

    assert keys("smith") & keys("smyth") and keys("balik") & keys("blik") and keys("koritz") & keys("koirtz")
    dice, n = random.Random(7), 0
    for _ in range(4000):
        a = b = "".join(dice.choices("abcdefgh", k=dice.randint(4, 12)))
        for _ in range(dice.randint(1, 2)):
            k = dice.randrange(len(b) - 1)
            b = dice.choice((b[:k] + b[k + 1 :], b[:k] + dice.choice("abcdefgh\ufffd") + b[k + 1 :], b[:k] + dice.choice("xyz") + b[k:], b[:k] + b[k + 1] + b[k] + b[k + 2 :]))
        if names.near(a, b):
            n += 1
            assert keys(a) & keys(b), (a, b)
    assert n > 1000


def test_learning_tells_matches_from_the_rest():
    counts = {"3-3311": 900, "3-30--": 500, "0-3311": 80, "0-0311": 700, "0-30--": 400, "2-3311": 50, "3-2311": 20, "3-321-": 20, "3-300-": 0, "3-3300": 9, "0-00--": 300}
    post = linkage.learn({p: n for p, n in counts.items() if n})
    assert all(post[p] > 0.9 for p in ("3-3311", "3-2311", "3-321-")) and post["2-3311"] > 0.8
    assert all(post[p] < 0.2 for p in ("3-30--", "0-3311", "0-0311", "0-30--", "0-00--")) and linkage.learn({}) == {}
    # The share of other firms must not matter: the two questions are told apart.
    many = linkage.learn({p: n for p, n in (counts | {"3-30--": 20_000}).items() if n})
    assert many["3-30--"] < 0.2 and many["3-3311"] > 0.9
