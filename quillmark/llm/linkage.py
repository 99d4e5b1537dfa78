"""Matching records of two tables that share no identifier, with a confidence.

Probabilistic record linkage: several blocking passes propose pairs, each attribute is compared into
agreement levels, and expectation-maximisation learns how often each level occurs among pairs of the
same person and of others, and among pairs of the same firm and of others; that both go together is
learnt too. The posterior of "same person at the same firm" is a pair's confidence, and nothing else
decides. All stages run on distinct profiles; rows of equal profiles share the outcome. Only pattern
counts reach the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import names
from quillmark.llm.variants import told
from quillmark.session import cut, spread

FIELDS = ("given", "middle", "surname", "core", "line", "legal")
LEVELS = ("0123", "01", "0123", "0123", "01", "01")
#: Least posterior of a match.
LEAST = 0.5
#: The two questions the fields answer: the same person, the same firm.
SIDES = (0, 0, 0, 1, 1, 1)
#: Pairs that the first view of the probabilities weighs as much as.
PRIOR = 50
#: Bound of the learnt share of plain disagreement in a field among pairs that are the same: a slip that makes another
#: word altogether is rare. Without it the two questions may drift into one.
APART = 0.001
SITE = re.compile(r"(?i)\s*[|–—-]\s*linked ?in\s*$")
SPLIT = re.compile(r"\s+[|–—-]\s+")


def title_parts(title: str | None) -> tuple[str, list[str]]:
    """Name a profile title begins with, and the segments that may hold a firm; cut segments hold none."""
    if not title or not title.strip():
        return "", []
    head, *rest = SPLIT.split(SITE.sub("", title.strip()))
    firms = []
    for segment in rest:
        if "..." in segment or "…" in segment:
            continue
        at = re.search(r"(?i)\bat\s+(.+)$", segment)
        firms.append(at[1] if at else segment)
    return ("" if "..." in head else head), firms


def _short_surname(text: str) -> tuple[str, str] | None:
    """Given name and initial of a name whose surname is cut to its initial ("Peter M.")."""
    m = re.fullmatch(r"\s*([^\W\d_]{2,})(?:\s+[^\W\d_]\.)?\s+([^\W\d_])\.?\s*", names.unscrambled(names.DEGREES.sub(" ", text)))
    return (names.fold(m[1]), names.fold(m[2])) if m else None


def hit_profile(person: str | None, company: str | None, title: str | None, common: frozenset[str]) -> dict | None:
    """What a hit says of one person at a firm; null without a title, without any firm, or if its title names someone else."""
    head, segments = title_parts(title)
    if not head:
        return None
    typed = names.person(person, common) if person and person.strip() else None
    shown, cut_name = names.person(head, common), _short_surname(head)
    given, middle, surnames = [], "", []
    if typed is not None and typed.surname:
        if cut_name:
            if typed.given and not names.same_given(typed.given[0], cut_name[0], common) or typed.surname[0] != cut_name[1]:
                return None
            given, surnames = [*typed.given[:1], cut_name[0]], [typed.surname]
        else:
            if shown is None or not names.near(typed.surname, shown.surname) or names.given_level(typed.given, shown.given, common) == 0:
                return None
            given, surnames = [*typed.given[:1], *shown.given[:1]], [typed.surname, shown.surname]
            middle = next((g[1][0] for g in (typed.given, shown.given) if len(g) > 1), "")
        if len(typed.given) > 1:
            middle = typed.given[1][0]
    elif shown is not None and shown.given and not cut_name:
        given, surnames = [shown.given[0]], [shown.surname]
        middle = shown.given[1][0] if len(shown.given) > 1 else ""
    if not given or not surnames:
        return None
    firms = [f for f in map(names.firm, [company] if company and company.strip() else segments) if f]
    firms += [f for f in map(names.firm, segments) if f and firms and names.near(f.core, firms[0].core)]
    if not firms:
        return None
    return {"g": list(dict.fromkeys(given)), "m": middle, "s": list(dict.fromkeys(surnames)), "f": list(dict.fromkeys(f.key for f in firms))}


def person_profile(person: str | None, company: str | None, common: frozenset[str]) -> dict | None:
    p = names.person(person, common) if person and person.strip() else None
    f = names.firm(company) if company and company.strip() else None
    if p is None or not p.given or not p.surname or f is None:
        return None
    return {"g": [p.given[0]], "m": p.given[1][0] if len(p.given) > 1 else "", "s": [p.surname], "f": [f.key]}


@lru_cache(maxsize=100_000)
def shortened(word: str) -> frozenset[str]:
    """The word with none, one or two signs left out; words of ``near`` share one, unless lost signs add to its edits."""
    once = {word[:k] + word[k + 1 :] for k in range(len(word))}
    return frozenset({word} | once | {w[:k] + w[k + 1 :] for w in once for k in range(len(w))})


def block_keys(profile: dict) -> list[str]:
    """Keys of the passes. Each holds a part of the firm's name beside a part of the person's, so neither a hot
    surname nor a hot firm makes one block: surname and initial; surname's ends or letters and initial; firm with
    the surname less up to two letters, or with either end of the surname, whoever bears it (what relatives and colleagues look like is learnt from these)."""
    letters = {x[0] for g in profile["g"] for x in (g, *names.FORMAL.get(g, ()))}
    cores = {f.split("|")[0] for f in profile["f"]}
    ends = {e for c in cores for e in (f"<{c[:2]}", f">{c[-3:]}")}
    keys = set()
    for s in profile["s"]:
        for a in letters:
            keys |= {k for e in ends for k in (f"s|{s}|{a}|{e}", f"l|{''.join(sorted(set(s)))}|{a}|{e}", f"o|{s[:4]}|{s[-4:]}|{a}|{e}")}
            keys |= {k for c in cores for k in (f"b|{c}|{s[:3]}", f"e|{c}|{s[-5:]}")}
        if len(s) >= 4:
            keys |= {f"d|{c}|{w}" for c in cores for w in shortened(s)}
    return sorted(keys)


def compare(a: dict, b: dict) -> str:
    """Agreement pattern, one sign per field; ``-`` where a side is silent, and for line and legal form of firms of
    different names. Of several readings of a hit the one that agrees best counts."""
    common = frozenset(a["k"]) | frozenset(b["k"])
    given = max(names.same_given(x, y, common) for x in a["g"] for y in b["g"])
    middle = "-" if not a["m"] or not b["m"] else str(int(a["m"] == b["m"]))
    surname = max(names.near(x, y) for x in a["s"] for y in b["s"])
    best = ("0", "-", "-")
    for x in a["f"]:
        for y in b["f"]:
            (cx, lx, fx), (cy, ly, fy) = x.split("|"), y.split("|")
            line, legal = names.line_level(tuple(lx.split()), tuple(ly.split())), names.legal_level(fx, fy)
            levels = (str(names.near(cx, cy)), "-" if line is None else str(line), "-" if legal is None else str(legal))
            best = max(best, levels, key=lambda t: (t[0], {"1": 2, "-": 1, "0": 0}[t[1]], {"1": 2, "-": 1, "0": 0}[t[2]]))
    if best[0] == "0":
        best = ("0", "-", "-")
    return "".join((str(given), middle, str(surname), *best))


def _start(agree: float) -> list[dict[str, float]]:
    out = []
    for levels in LEVELS:
        weight = {x: agree if x != "0" else 1 - agree for x in levels}
        out.append({x: w / sum(weight.values()) for x, w in weight.items()})
    return out


def _posterior(pattern: str, joint: dict[tuple[int, int], float], tables: tuple[list, list]) -> dict[tuple[int, int], float]:
    """P(same person, same firm | pattern) of the four cases; silent fields say nothing."""
    like = [[1.0, 1.0], [1.0, 1.0]]
    for k, x in enumerate(pattern):
        if x != "-":
            for same in (0, 1):
                like[SIDES[k]][same] *= tables[same][k][x]
    weight = {c: share * like[0][c[0]] * like[1][c[1]] for c, share in joint.items()}
    whole = sum(weight.values())
    return {c: w / whole for c, w in weight.items()}


def learn(patterns: dict[str, int], most: int = 500) -> dict[str, float]:
    """Posterior per pattern by expectation-maximisation over pattern counts, until it stands still.

    Starts from the view that pairs of the same nearly always agree and others mostly do not, and holds on to
    it with the weight of ``PRIOR`` pairs, which only matters in tiny tables."""
    if not patterns:
        return {}
    tables = (_start(0.3), _start(0.95))
    prior = tuple([dict(t) for t in side] for side in tables)
    joint = first = {(1, 1): 0.1, (1, 0): 0.2, (0, 1): 0.2, (0, 0): 0.5}
    whole = sum(patterns.values())
    before: dict[str, float] = {}
    for _ in range(most):
        post = {p: _posterior(p, joint, tables) for p in patterns}
        now = {p: c[1, 1] for p, c in post.items()}
        if before and max(abs(now[p] - before[p]) for p in now) < 1e-6:
            break
        before = now
        joint = {c: (sum(n * post[p][c] for p, n in patterns.items()) + PRIOR * first[c]) / (whole + PRIOR) for c in first}
        for same in (0, 1):
            for k, levels in enumerate(LEVELS):
                mass = {x: PRIOR * prior[same][k][x] for x in levels}
                for p, n in patterns.items():
                    if p[k] != "-":
                        mass[p[k]] += n * sum(v for c, v in post[p].items() if c[SIDES[k]] == same)
                share = {x: m / sum(mass.values()) for x, m in mass.items()}
                if same and share["0"] > APART:
                    rest = (1 - APART) / (1 - share["0"])
                    share = {x: APART if x == "0" else v * rest for x, v in share.items()}
                tables[same][k] = share
    return before


def _id(*columns: str) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("0")) for c in columns]))


def _profiles(df: DataFrame, columns: tuple[str, ...], read, name: str) -> DataFrame:  # noqa: ANN001
    """(id, profile, keys) of the distinct readable rows; ``known`` holds the given names in a row's own words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, profiles, keys = [], [], []
            for own, known, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = read(*values, frozenset(known or ()))
                if p is not None:
                    ids.append(own)
                    profiles.append(json.dumps(p | {"k": sorted(known or ())}))
                    keys.append(block_keys(p))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(profiles, pa.string()), pa.array(keys, pa.list_(pa.string()))], names=["id", "profile", "keys"])

    rows = df.select("id", "known", *columns).mapInArrow(run, "id string, profile string, keys array<string>")
    return cut(rows.withColumnsRenamed({"id": f"{name}_id", "profile": f"{name}_profile"}))


def match(hits: DataFrame, people: DataFrame) -> DataFrame:
    """(hit_id, person_id, confidence, pattern) of every proposed pair.

    Hits without a title or any firm, hits whose title names someone else, and people without name or firm
    match nobody. Equal rows on either side are each matched. Null ids are kept. Empty tables give an
    empty result. Other columns than the names, firms, titles and ids are not read."""
    spark = hits.sparkSession
    hit_columns, person_columns = ("person_name", "company_name", "linkedin_title"), ("person_name", "company_name")
    titled = hits.where("trim(linkedin_title) <> ''")

    @F.pandas_udf("string")
    def head(titles: pd.Series) -> pd.Series:
        return pd.Series([title_parts(t)[0] or None for t in titles], dtype="object")

    # Equal rows are one profile each from here on.
    left = cut(spread(titled.select(_id(*hit_columns).alias("id"), *hit_columns).dropDuplicates(["id"])).withColumn("head", head("linkedin_title")))
    right = cut(spread(people.select(_id(*person_columns).alias("id"), *person_columns).dropDuplicates(["id"])))
    typed = left.select(F.explode(F.array("person_name", "head")).alias("value")).unionByName(right.select(F.col("person_name").alias("value")))
    known = told(typed.where("trim(value) <> ''").select(F.lit("person").alias("kind"), "value").distinct()).where(F.size("known") > 0)
    of = lambda c, n: known.select(F.col("value").alias(c), F.col("known").alias(n))
    left = left.join(of("person_name", "known_a"), "person_name", "left").join(of("head", "known_b"), "head", "left")
    left = left.withColumn("known", F.array_union(F.coalesce("known_a", F.array().cast("array<string>")), F.coalesce("known_b", F.array().cast("array<string>"))))
    left = _profiles(left, hit_columns, hit_profile, "h")
    right = _profiles(right.join(of("person_name", "known"), "person_name", "left"), person_columns, person_profile, "p")
    a = left.select("h_id", F.explode("keys").alias("key"))
    b = right.select("p_id", F.explode("keys").alias("key"))
    pairs = a.join(b, "key").select("h_id", "p_id").distinct()
    held = pairs.join(left.select("h_id", "h_profile"), "h_id").join(right.select("p_id", "p_profile"), "p_id")

    @F.pandas_udf("string")
    def pattern(x: pd.Series, y: pd.Series) -> pd.Series:
        read: dict[str, dict] = {t: json.loads(t) for t in {*x, *y}}
        return pd.Series([compare(read[s], read[t]) for s, t in zip(x, y, strict=True)], dtype="object")

    compared = cut(held.select("h_id", "p_id", pattern("h_profile", "p_profile").alias("pattern")))
    counts = {r["pattern"]: r["n"] for r in compared.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(list(learn(counts).items()) or [("", 0.0)], "pattern string, confidence double")
    scored = compared.join(F.broadcast(table), "pattern")  # at most one row per agreement pattern
    own_h = titled.select("hit_id", _id(*hit_columns).alias("h_id"))
    own_p = people.select("person_id", _id(*person_columns).alias("p_id"))
    return scored.join(own_h, "h_id").join(own_p, "p_id").select("hit_id", "person_id", "confidence", "pattern")


def found(hits: DataFrame, people: DataFrame) -> DataFrame:
    return match(hits, people).where(F.col("confidence") >= LEAST).select("hit_id", "person_id").distinct()


def calibration(hits: DataFrame, people: DataFrame) -> DataFrame:
    """(band, n_pairs, mean_confidence, same_position, other_position): per tenth of confidence, how many pairs agree in the
    position, which no field compares; only pairs with a position on both sides are counted in the last two."""
    spots = hits.select("hit_id", F.lower(F.trim("position")).alias("a")), people.select("person_id", F.lower(F.trim("position")).alias("b"))
    held = match(hits, people).join(spots[0], "hit_id").join(spots[1], "person_id")
    band = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int").alias("band")
    return held.groupBy(band).agg(F.count("*").alias("n_pairs"), F.avg("confidence").alias("mean_confidence"), F.count_if((F.col("a") != "") & (F.col("a") == F.col("b"))).alias("same_position"), F.count_if((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))).alias("other_position"))
