"""Finding and undoing wrong character decoding.

A swap of code pages is a substitution cipher: each letter of the plain text stands as a fixed
group of signs. The operator

1. cuts every value into cipher symbols (groups of signs that the bytes of one UTF-8 character
   would show under some single-byte code page) and counts them with their neighbours,
2. learns, per code page as the source of the cipher, which letter each symbol stands for by
   expectation-maximisation against the letter bigrams of the corpus itself; "nothing was
   replaced" is one of the alternatives, so correct text stays as it is,
3. applies the learnt alphabet with ``translate()``, until nothing changes, for text decoded wrongly several times.

Values that hold U+FFFD lost signs for good: they are found, and what is left is kept as it is.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut, spread

#: Single-byte code pages that UTF-8 text is read with by mistake.
CODE_PAGES = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251")
LOST = "�"
#: Symbols are held as single signs of a private plane while they are translated.
PRIVATE = 0xF0000


def _table(page: str) -> dict[int, str]:
    """Byte to sign; bytes the page leaves undefined stand for the control sign of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


TABLES = {page: _table(page) for page in CODE_PAGES}
REVERSE = {page: {sign: b for b, sign in t.items()} for page, t in TABLES.items()}


def _signs(page: str, lo: int, hi: int) -> str:
    return "".join(re.escape(TABLES[page][b]) for b in range(lo, hi))


def _unit(page: str) -> str:
    tail = f"[{_signs(page, 0x80, 0xC0)}]"
    return f"[{_signs(page, 0xC2, 0xE0)}]{tail}|[{_signs(page, 0xE0, 0xF0)}]{tail}{{2}}|[{_signs(page, 0xF0, 0xF5)}]{tail}{{3}}"


UNIT = re.compile("|".join(f"(?:{_unit(p)})" for p in sorted(CODE_PAGES, key=lambda p: p != "cp1252")))
#: A lead sign and a tail sign of any page: a quick test that most texts fail.
COARSE = re.compile(f"[{''.join(_signs(p, 0xC2, 0xF5) for p in CODE_PAGES)}][{''.join(_signs(p, 0x80, 0xC0) for p in CODE_PAGES)}]")
#: (page the text was written in, page it was read with): swaps of one sign for one sign.
SWAPS = tuple((written, read) for written in ("cp1251", "koi8-r", "cp866") for read in ("cp1252",))
_LEADS = sorted({ord(TABLES[p][b]) for p in CODE_PAGES for b in range(0xC2, 0xF5)})


#: Natural logarithm of the odds against a letter that none of the usual alphabets has.
ODD = 5.0


def odd(letter: str) -> bool:
    o = ord(letter)
    return letter.isalpha() and not (o < 0x180 or 0x218 <= o <= 0x21B or 0x370 <= o < 0x530)


def has_symbol(text: str) -> bool:
    return COARSE.search(text) is not None and UNIT.search(text) is not None


def candidates(symbol: str) -> dict[str, list[str]]:
    """What the symbol stands for under each code page that can have made it."""
    out: dict[str, list[str]] = defaultdict(list)
    for page in CODE_PAGES:
        back = REVERSE[page]
        if all(s in back for s in symbol):
            try:
                plain = bytes(back[s] for s in symbol).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(plain) == 1 and plain.isprintable() or plain in " ‍️­" or (len(plain) == 1 and 0x80 <= ord(plain) < 0xA0):
                out[plain].append(page)
    return dict(out)


def _class(ch: str) -> int:
    if ch == "" or ch.isspace():
        return 0
    if ch.islower():
        return 1
    if ch.isupper():
        return 2
    if ch.isdigit():
        return 3
    if ch in ".,;:!?'\"()-–—‘’“”„…«»/":
        return 4
    if ord(ch) >= 0x2600 or ch in "‍️":
        return 5
    return 6


class Bigrams:
    """Smoothed P(next sign | sign) of the corpus, with sign classes behind unseen pairs."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs, self.left, self.single = pairs, defaultdict(int), defaultdict(int)
        self.classes, self.class_left, self.in_class, self.size = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
        for (a, b), n in pairs.items():
            self.left[a] += n
            self.single[b] += n
            self.classes[_class(a), _class(b)] += n
            self.class_left[_class(a)] += n
        for b, n in self.single.items():
            self.in_class[_class(b)] += n
            self.size[_class(b)] += 1

    def p(self, a: str | None, b: str | None) -> float:
        """Unknown neighbours (other symbols, ends of the alphabet) tell nothing."""
        if a is None or b is None:
            return 1e-2
        ca, cb = _class(a), _class(b)
        of_class = (self.classes[ca, cb] + 0.1) / (self.class_left[ca] + 1)
        within = (self.single[b] + 0.02) / (self.in_class[cb] + 0.02 * (self.size[cb] + 200))
        n = self.left[a]
        return (self.pairs.get((a, b), 0) + 5 * of_class * within) / (n + 5)


def count_bigrams(df: DataFrame) -> DataFrame:
    """Counts of neighbouring signs in column ``value``; bounded by the alphabet, not the corpus.

    Rows with cipher symbols or lost signs are left to the other side of the model.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "\n".join(v for v in batch.column(0).to_pylist() if v and LOST not in v and not has_symbol(v))
            if text:
                codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                pairs, n = np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)
                yield pa.record_batch([pa.array(pairs >> 21), pa.array(pairs & (1 << 21) - 1), pa.array(n)], names=["a", "b", "n"])

    return df.select("value").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def count_symbols(df: DataFrame) -> DataFrame:
    """(symbol, left, right, n): cipher symbols with their neighbours, pre-added per partition.
    A neighbour that is part of another symbol is null. Bounded by the alphabet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if not value or not COARSE.search(value):
                    continue
                spans = [m.span() for m in UNIT.finditer(value)]
                starts, ends = {a for a, _ in spans}, {b for _, b in spans}
                for a, b in spans:
                    left = None if a in ends else value[a - 1] if a else "\n"
                    right = None if b in starts else value[b] if b < len(value) else "\n"
                    seen[value[a:b], left, right] += 1
        if seen:
            rows = list(zip(*((*k, n) for k, n in seen.items()), strict=True))
            yield pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["symbol", "l", "r", "n"])

    return df.select("value").mapInArrow(run, "symbol string, l string, r string, n long").groupBy("symbol", "l", "r").agg(F.sum("n").alias("n"))


def learn(symbols: list[tuple[str, str | None, str | None, int]], bigrams: Bigrams, steps: int = 12) -> dict[str, str]:
    """Expectation-maximisation of P(letter | symbol): the expectation weighs each letter by the
    bigrams with both neighbours, the maximisation adds up over all places of the symbol and, as
    the prior, over the code page (the source) the letter comes from."""
    places: dict[str, list[tuple[str | None, str | None, int]]] = defaultdict(list)
    for symbol, left, right, n in symbols:
        places[symbol].append((left, right, n))
    options: dict[str, list[tuple[str | None, list[str]]]] = {}
    for symbol in places:
        if found := candidates(symbol):
            options[symbol] = [(None, [])] + sorted(found.items())
    share = {p: 1.0 for p in CODE_PAGES}
    weight = {s: np.array([0.5, *([0.5 / (len(o) - 1)] * (len(o) - 1))]) for s, o in options.items()}
    odds: dict[str, np.ndarray] = {}
    for s, o in options.items():
        rows = []
        for left, right, _ in places[s]:
            row = []
            for letter, _ in o:
                chain = s if letter is None else letter
                p = math.log(bigrams.p(left, chain[0])) + math.log(bigrams.p(chain[-1], right))
                p += sum(math.log(bigrams.p(a, b)) for a, b in zip(chain, chain[1:], strict=False))
                p -= ODD * (letter is not None and odd(letter))
                row.append(p)
            rows.append(row)
        x = np.array(rows)
        odds[s] = np.exp(np.clip(x - x.max(1, keepdims=True), -60, 0))
    for _ in range(steps):
        pages: dict[str, float] = defaultdict(float)
        for s, o in options.items():
            post = odds[s] * weight[s]
            post /= post.sum(1, keepdims=True)
            n = np.array([k for *_, k in places[s]], float)
            mass = (post * n[:, None]).sum(0)
            for (_, from_pages), m in zip(o[1:], mass[1:], strict=True):
                whole = sum(share[p] for p in from_pages)
                for p in from_pages:
                    pages[p] += m * share[p] / whole
            prior = np.array([1.0, *(sum(share[p] for p in ps) for _, ps in o[1:])])
            prior[1:] /= max(prior[1:].sum(), 1e-9)
            weight[s] = (mass + prior) / (mass + prior).sum()
        top = sum(pages.values()) or 1.0
        share = {p: (pages[p] + 1) / (top + len(CODE_PAGES)) for p in CODE_PAGES}
    out = {}
    for s, o in options.items():
        best = int(weight[s].argmax())
        if best:
            out[s] = o[best][0]
    return out


def _collapse(df: DataFrame, alphabet: dict[str, str]) -> DataFrame:
    """Each known symbol as one private sign, longest first."""
    order = sorted(alphabet)
    sign = {s: chr(PRIVATE + k) for k, s in enumerate(order)}
    pattern = re.compile("|".join(re.escape(s) for s in sorted(order, key=lambda s: (-len(s), s))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pattern.sub(lambda m: sign[m[0]], t) for t in batch.column("now").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("now"), "now", pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def decode_round(suspects: DataFrame, bigrams: Bigrams) -> DataFrame:
    """One learn-and-apply round over column ``now``."""
    rows = [(r["symbol"], r["l"], r["r"], r["n"]) for r in count_symbols(suspects.select(F.col("now").alias("value"))).collect()]
    alphabet = learn(rows, bigrams)
    if not alphabet:
        return suspects.withColumn("changed", F.lit(False))
    order = sorted(alphabet)
    signs = "".join(chr(PRIVATE + k) for k in range(len(order)))
    plain = "".join(alphabet[s] for s in order)
    done = _collapse(suspects.withColumn("before", F.col("now")), alphabet).withColumn("now", F.translate("now", signs, plain))
    return done.withColumn("changed", F.col("before") != F.col("now")).drop("before")


def repair(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, before, after, restorable) of every value that was decoded wrongly.

    Null and empty values are never found. ``restorable`` is false where signs were lost (U+FFFD);
    ``after`` then holds what could be given back. Equal rows give equal results; a null key is
    kept. Only ``key`` and ``fields`` are read. Bigrams are counted over all values.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")
    values = df.select(F.col(key), cells).select(key, "c.field", "c.value")
    values = values.where("value IS NOT NULL AND value <> ''")
    bigrams = Bigrams({(chr(r["a"]), chr(r["b"])): r["n"] for r in count_bigrams(spread(values)).collect()})
    leads = "".join(f"\\x{{{c:x}}}" for c in [*_LEADS, ord(LOST)])
    # Pushed next to the scan: most rows hold none of these signs.
    suspects = cut(spread(values.where(F.col("value").rlike(f"[{leads}]"))).withColumn("now", F.col("value")))
    open_, closed = swap_round(suspects, bigrams), []
    while not open_.isEmpty():  # until nothing changes; a change puts one sign for several, so this ends
        step = cut(decode_round(open_, bigrams))
        closed.append(step.where("NOT changed").drop("changed"))
        open_ = step.where("changed").drop("changed")
    done = reduce(DataFrame.unionByName, closed, suspects.limit(0))
    lost = F.col("value").contains(LOST)
    return done.where((F.col("value") != F.col("now")) | lost).select(key, "field", F.col("value").alias("before"), F.col("now").alias("after"), (~lost).alias("restorable"))


def _swap_table(written: str, read: str) -> dict[int, str]:
    """Sign shown to sign meant, for the letters of the upper half."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            shown, meant = TABLES[read][b] if read in TABLES else bytes([b]).decode(read), bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if meant.isalpha():
            out[ord(shown)] = meant
    return out


SWAP_TABLES = {s: _swap_table(*s) for s in SWAPS}
#: Words of upper-half letters only, as Cyrillic read as Western text shows.
RUN = re.compile(r"(?<![^\W\d_])[À-ÿ¸¨]+(?![^\W\d_])")
#: Natural logarithms of odds that a value, and a run in it, must gain to be taken as swapped.
VALUE_GAIN, RUN_GAIN = 8.0, 1.0


def _gain(run: str, swapped: str, bigrams: Bigrams) -> float:
    own = sum(math.log(bigrams.p(a, b)) for a, b in zip(f" {run}", f"{run} ", strict=True))
    return sum(math.log(bigrams.p(a, b)) for a, b in zip(f" {swapped}", f"{swapped} ", strict=True)) - own


def undo_swaps(text: str, bigrams: Bigrams, prior: dict[tuple[str, str], float], memory: dict) -> tuple[str, tuple[str, str] | None]:
    """The text under the likeliest page swap, if one beats leaving it alone."""
    runs = {m[0] for m in RUN.finditer(text)}
    if max(map(len, runs), default=0) < 3:
        return text, None
    best, gain_of = None, {}
    for swap, table in SWAP_TABLES.items():
        gains = {}
        for run in runs:
            if (swap, run) not in memory:
                swapped = run.translate(table)
                memory[swap, run] = (swapped, _gain(run, swapped, bigrams) if swapped != run else 0.0)
            swapped, gain = memory[swap, run]
            if gain > RUN_GAIN:
                gains[run] = (swapped, gain)
        # Short words follow the others; on their own they prove nothing.
        total = sum(g for r, (_, g) in gains.items() if len(r) > 2) + math.log(prior.get(swap, 1.0 / len(SWAPS)))
        if gains and (best is None or total > best[0]):
            best, gain_of = (total, swap), gains
    if best is None or best[0] < VALUE_GAIN:
        return text, None
    return RUN.sub(lambda m: gain_of.get(m[0], (m[0],))[0], text), best[1]


def swap_round(suspects: DataFrame, bigrams: Bigrams) -> DataFrame:
    """Mixture of page swaps over whole values: the expectation assigns each value its swap, the
    maximisation counts how common each swap is; the counts then serve as prior."""
    schema = f"{suspects.schema.simpleString()[7:-1].replace(':', ' ')}, swap string"
    shared = suspects.sparkSession.sparkContext.broadcast(bigrams)

    def apply(prior: dict[tuple[str, str], float]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory: dict = {}
            for batch in batches:
                if len(memory) > 200_000:
                    memory.clear()
                done = [undo_swaps(t, shared.value, prior, memory) for t in batch.column("now").to_pylist()]
                out = batch.set_column(batch.schema.get_field_index("now"), "now", pa.array([t for t, _ in done], pa.string()))
                yield out.append_column("swap", pa.array([s and ">".join(s) for _, s in done], pa.string()))

        return suspects.mapInArrow(run, schema)

    seen = {tuple(r["swap"].split(">")): r["n"] for r in apply({}).where("swap IS NOT NULL").groupBy("swap").agg(F.count("*").alias("n")).collect()}
    whole = sum(seen.values()) + len(SWAPS)
    return apply({s: (seen.get(s, 0) + 1) / whole for s in SWAPS}).drop("swap") if seen else suspects


FIELDS = ("post_text", "author_name", "reshared_text")


def found(df: DataFrame) -> DataFrame:
    return repair(df, "row_id", FIELDS).select("row_id", "field").distinct()
