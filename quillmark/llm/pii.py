"""Personal information in free text, as typed placeholders.

A character-level bidirectional LSTM scores every sign, CRF transitions tie the scores of
neighbours together. Long texts are cut into overlapping windows; the windows' scores are merged,
each weighted by how far inside its window a sign lies, and one Viterbi decoding runs over the whole
text, so a window's edge never cuts a span. The weights were trained here in numpy from
labelled spans (``pii_training``) and are sent to the tasks by broadcast. Equal texts are read once.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: 0 outside, then begin and inside of each type.
N_TAGS = 1 + 2 * len(TYPES)
FIELDS = ("post_text", "reshared_text")
WINDOW, OVERLAP = 256, 48
#: Windows scored together, and signs of texts held at once.
BATCH, SIGNS = 256, 120_000
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_ASCII = 32
N_SIGNS = 2 + 95 + 14


def _code(ch: str) -> int:
    """Sign to number: 0 padding, 1 line break, ASCII as such, letters with marks as their base
    letter, all else by kind."""
    o = ord(ch)
    if ch == "\n":
        return 1
    if 32 <= o < 127:
        return 2 + o - _ASCII
    base = unicodedata.normalize("NFKD", ch)[0]
    if 32 <= ord(base) < 127 and base.isalpha():
        return 2 + ord(base) - _ASCII
    special = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "s", "æ": "a", "Æ": "A", "œ": "o", "đ": "d", "–": "-", "—": "-", "’": "'", "‘": "'", "“": '"', "”": '"', "„": '"', " ": " "}
    if ch in special:
        return 2 + ord(special[ch]) - _ASCII
    kinds = (str.isspace, lambda c: "а" <= c.lower() <= "я" and c.islower(), lambda c: "А" <= c.upper() <= "Я", str.isdigit, str.islower, str.isupper, str.isalpha)
    for k, test in enumerate(kinds):
        if test(ch):
            return 97 + k
    category = unicodedata.category(ch)
    return 97 + 7 + {"P": 0, "S": 1, "M": 2, "C": 3, "Z": 4}.get(category[0], 5)


@cache
def _codes() -> np.ndarray:
    return np.array([_code(chr(o)) if not 0xD800 <= o < 0xE000 else 97 + 12 for o in range(0x3000)], np.int16)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 0x3000, _codes()[np.minimum(points, 0x2FFF)], 97 + 8)


class Tagger:
    """Forward pass of the trained network, both directions at once."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.hidden = weights["wh"].shape[1]
        h = self.hidden
        # Sigmoids are computed as tanh: one call serves all four gates.
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        table = np.einsum("ve,deg->dvg", weights["embedding"], weights["wx"]) + weights["b"][:, None]
        self.table = (table * half).astype(np.float32)
        self.wh = (weights["wh"] * half).astype(np.float32)
        self.out, self.bias = weights["out"].astype(np.float32), weights["bias"].astype(np.float32)
        self.trans, self.first = weights["trans"].astype(np.float32), weights["first"].astype(np.float32)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(windows, time) sign numbers to (windows, time, tags)."""
        n, time = ids.shape
        h = self.hidden
        both = np.stack([ids, ids[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        seen = np.empty((time, 2, n, h), np.float32)
        side = np.arange(2)[:, None]
        for t in range(time):
            gates = np.matmul(state, self.wh)
            gates += self.table[side, both[:, :, t]]
            np.tanh(gates, out=gates)
            inner = gates[..., : 3 * h]
            inner += 1
            inner *= 0.5
            cell *= gates[..., h : 2 * h]
            cell += gates[..., :h] * gates[..., 3 * h :]
            state = np.tanh(cell)
            state *= gates[..., 2 * h : 3 * h]
            seen[t] = state
        joined = np.concatenate([seen[:, 0], seen[::-1, 1]], 2)
        return (joined.reshape(-1, 2 * h) @ self.out + self.bias).reshape(time, n, -1).transpose(1, 0, 2)

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of every sign of every text."""
        codes = [encode(t) for t in texts]
        pieces = [(k, a) for k, c in enumerate(codes) for a in window_starts(len(c))]
        pieces.sort(key=lambda p: min(WINDOW, len(codes[p[0]]) - p[1]))
        merged = [np.zeros((len(c), N_TAGS), np.float32) for c in codes]
        weight = [np.zeros(len(c), np.float32) for c in codes]
        for at in range(0, len(pieces), BATCH):
            group = pieces[at : at + BATCH]
            longest = max(min(WINDOW, len(codes[k]) - a) for k, a in group)
            ids = np.zeros((len(group), longest + 2), np.int64)  # padded by one sign on both sides
            for row, (k, a) in enumerate(group):
                part = codes[k][a : a + WINDOW]
                ids[row, 1 : 1 + len(part)] = part
            got = self.scores(ids)
            for row, (k, a) in enumerate(group):
                size = min(WINDOW, len(codes[k]) - a)
                trust = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(np.float32)
                if a == 0:
                    trust = np.minimum(np.arange(size, 0, -1), WINDOW).astype(np.float32)
                if a + size == len(codes[k]):
                    trust = np.full(size, WINDOW, np.float32) if a == 0 else np.arange(1, size + 1, dtype=np.float32)
                merged[k][a : a + size] += got[row, 1 : 1 + size] * trust[:, None]
                weight[k][a : a + size] += trust
        for m, w in zip(merged, weight, strict=True):
            m /= np.maximum(w, 1e-6)[:, None]
        return self.decode(merged)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over whole texts, those of like length side by side."""
        out: list[np.ndarray] = [np.zeros(len(s), np.int8) for s in scores]
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        for at in range(0, len(order), BATCH):
            group = [k for k in order[at : at + BATCH] if len(scores[k])]
            if not group:
                continue
            time = len(scores[group[0]])
            sizes = np.array([len(scores[k]) for k in group])
            back = np.zeros((time, len(group), N_TAGS), np.int8)
            best = np.stack([scores[k][0] for k in group]) + self.first
            for t in range(1, time):
                live = int((sizes > t).sum())  # sorted by length, so the live ones come first
                step = best[:live, :, None] + self.trans
                back[t, :live] = step.argmax(1)
                best[:live] = step.max(1) + np.stack([scores[k][t] for k in group[:live]])
            for row, k in enumerate(group):
                tag = int(best[row].argmax())
                for t in range(sizes[row] - 1, -1, -1):
                    out[k][t] = tag
                    tag = int(back[t, row, tag])
        return out


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, WINDOW - OVERLAP), n - WINDOW]


#: A span of a type must at least look like this; decides nothing between types.
NO_NAME = frozenset("also and are as but con das die et for from has have il in is it la le mit no not on or our pas que the this und was we with you your als bei como die des dies ist nicht oder sind wir avec pour dans est nous vous para por como esta este pero una più non per che alla som och det att för med van een het niet voor tym jest oraz dla nie wszystkim wszystko który która którzy które".split())
_AT = re.compile(r"@|\bat\b|\b(?:arroba|chiocciola|arobase|apenstaartje|snabel-a|małpa|собака|klammeraffe)\b", re.I)
LOST = "\ufffd"


def plausible(kind: str, span: str) -> bool:
    digits = sum(c.isdigit() for c in span)
    words = re.findall(rf"(?:[^\W\d_]|{LOST})+", span)
    if kind == "email":
        return bool(_AT.search(span)) and len(span) >= 6
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and any(len(w) > 2 for w in words)
    if digits or not words or (len(words) < 2 and LOST not in span):
        return False
    if not re.search(r"[\s,]", span) and not re.match(r"\w\.", span):
        return False
    ends = [w for w in (words[0], words[-1]) if w.islower() or len(w) > 3]
    return not NO_NAME & {w.casefold() for w in ends} and any(len(w) > 1 for w in words)


def spans(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of each decoded span; blanks and stops at its ends are left outside."""
    out = []
    k, n = 0, len(tags)
    inside = np.flatnonzero(tags)
    if not len(inside):
        return out
    k = int(inside[0])
    while k < n:
        if tags[k] == 0:
            k += 1
            continue
        kind = (int(tags[k]) - 1) // 2
        end = k + 1
        while end < n and tags[end] == 2 * kind + 2:
            end += 1
        a, b = k, end
        while a < b and text[a] in " \n\t.,;:!?":
            a += 1
        while b > a and text[b - 1] in " \n\t,;:!?":
            b -= 1
        if b > a and plausible(TYPES[kind], text[a:b]):
            out.append((a, b, TYPES[kind]))
        k = end
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span as ``[TYPE]``, all else unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def load_weights(path: Path | str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(Path(path).read_bytes())) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def detect(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS, weights: Path | str = WEIGHTS) -> DataFrame:
    """(key, field, before, after, spans) of every field that holds personal information.

    ``spans`` are (start, end, type) in signs from 0. Null and empty texts give nothing; a text of
    any length is read whole. Equal rows are each reported; equal texts are read once in the whole table.
    A null key is kept. Only ``key`` and ``fields`` are read, in one scan."""
    shared = df.sparkSession.sparkContext.broadcast(load_weights(weights))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for at, part in by_signs(batch.column(1).to_pylist()):
                rows = [(at + k, t, s) for k, (t, tags) in enumerate(zip(part, tagger.tag(part), strict=True)) if (s := spans(t, tags))]
                of = batch.column(0).take(pa.array([k for k, *_ in rows], pa.int64()))
                after = pa.array([redact(t, s) for _, t, s in rows], pa.string())
                cells = pa.array([[{"start": a, "end": b, "type": c} for a, b, c in s] for *_, s in rows], span_type)
                yield pa.record_batch([of, pa.array([t for _, t, _ in rows], pa.string()), after, cells], names=["text_id", "before", "after", "spans"])

    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("c")
    rows = df.select(F.col(key), cells).select(key, "c.field", "c.text").where("text IS NOT NULL AND text <> ''").withColumn("text_id", F.sha2("text", 256))
    once = spread(rows.groupBy("text_id").agg(F.first("text").alias("text")))
    read = once.mapInArrow(run, "text_id string, before string, after string, spans array<struct<start:int,end:int,type:string>>")
    return rows.select(key, "field", "text_id").join(read, "text_id").select(key, "field", "before", "after", "spans")


def by_signs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in parts of about ``SIGNS``."""
    part: list[str] = []
    size, first = 0, 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= SIGNS:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def found(df: DataFrame) -> DataFrame:
    """(row_id, field, pii_type) of each type a field holds."""
    return detect(df).select("row_id", "field", F.explode(F.array_distinct("spans.type")).alias("pii_type")).distinct()
