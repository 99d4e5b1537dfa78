"""Languages of documents and of their segments, without or against the delivered label.

Letter-trigram models of the ten languages are counted over the whole corpus: first by the
labels as delivered, then again by what the first models make of each sentence, so wrong labels
lose their weight. A document is a mixture of languages: expectation-maximisation estimates its
proportions from the sentences' likelihoods, and the set of languages is the one of the best
penalised likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru")
#: Other forms of a label (three-letter codes, English names).
LABELS = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"), "pt": ("por", "portuguese"), "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"), "sv": ("swe", "swedish"), "pl": ("pol", "polish"), "ru": ("rus", "russian"),
}
CODES = {form: code for code, forms in LABELS.items() for form in (code, *forms)}
MISSING = ("", "und", "unknown", "null", "none", "zxx", "mis", "mul")
#: Everyday words that start the models where a language has few or no labelled rows.
SEEDS = {
    "en": "the of and to in is that it was for with as on be at by this have from or had not are but what we were when your can said there use an each which she do how their if will up about out many then them these so some her would make like him into time has look two more",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde unser unsere",
    "fr": "le la les de des et en un une du que est pour qui dans ce il pas au sur plus par ne se avec son sont nous vous été cette mais ont comme ou si leur y dont aux même notre fait elle deux ces après sans peut très bien aussi",
    "es": "el la los las de que y en un una por con no para su se lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante nuestro nuestra ha son fue",
    "pt": "o a os as de que e do da em um uma para com não no na por mais dos das como mas ao ele se foi seu sua ou quando muito nos já também só pelo pela até isso ela entre depois sem mesmo aos ter seus nossa nosso são está",
    "it": "il lo la i gli le di che e è un una in per con non sono del della dei delle da al si come più ma anche nel alla ha o se questo questa nostro nostra molto dopo senza tutti essere stato loro quando cosa perché",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over ze zich hij naar heeft hebben wordt deze onze ons werd meer geen zal tot dit kan was we wat worden",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra vår våra",
    "pl": "i w na z do się nie że to jest o jak po co tak za od czy przez dla był ale już tylko jego może przed tym być ma są nasz nasza nasze które który oraz także bardzo lub aby jeszcze gdy więc nad pod bez",
    "ru": "и в не на что он с как это по но они мы из у за от то для же все так его бы только о мне было вот меня еще нет ему когда даже ну если уже или ни быть был до вас нибудь наш наша наше свой этого который после чтобы",
}
SIZE = 1 << 18
PAD = 255
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|[#@]\w+|\{[^{}]*\}|\S*[\d_/\\<>{}=]\S*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’')]*\s+|[\r\n]+|(?<=[.!?…][”»])\s*")
#: A quotation that begins in small letters: a fragment within a sentence, never a sentence of its own.
LOWER_QUOTE = re.compile(r"[“„«\"]\s*([a-zà-öø-ÿа-яęóąśłżźćń][^“”„«»\"]*)[”“»\"]")
#: A segment of so many words and letters can make a language part of the mixture.
LEAST_WORDS, LEAST_LETTERS = 3, 12
#: Natural logarithm of the odds a further language must gain.
PENALTY = 14.0
TEXTS = 400


def canonical(label: str | None) -> str | None:
    """The language a label names in any of its forms; null where it names none."""
    if label is None:
        return None
    text = label.strip().lower()
    if text in MISSING:
        return None
    head = re.split(r"[-_\s(]", text, maxsplit=1)[0]
    return CODES.get(text) or CODES.get(head) or "other"


_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýÿßœąćęłńśźżšžабвгдежзийклмнопрстуфхцчшщъыьэюяё'"
_INDEX = np.full(0x10000, PAD, np.uint8)
_INDEX[ord(" ")] = 0
for _k, _c in enumerate(_LETTERS):
    _INDEX[ord(_c)] = _k + 1
_INDEX[ord("’")] = _INDEX[ord("'")]


def segments(text: str | None) -> list[tuple[str, str, int, bool]]:
    """(segment as written, its words in lower case, number of words, whole) of a text with words. Segments are sentences;
    a quoted fragment is a segment of its own, of any length, but no whole sentence."""
    out = []
    for part in SENTENCE.split(text or ""):
        if not part:
            continue
        clean = NOISE.sub(" ", part)
        pieces = [(part.strip(), LOWER_QUOTE.sub(" ", clean), True), *((m[0], m[1], False) for m in LOWER_QUOTE.finditer(clean))]
        for raw, piece, whole in pieces:
            if words := WORD.findall(piece.lower()):
                out.append((raw, f" {' '.join(words)} ", len(words), whole))
    return out


SEGMENTS = "array<struct<raw:string,words:string,n:int,whole:boolean>>"


def split(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, label, segments) of every text with words; cut once, read by each pass after it."""
    kind = "" if key is None else f"`{key}` {df.schema[key].dataType.simpleString()}, "
    cell = pa.list_(pa.struct([("raw", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("whole", pa.bool_())]))
    names = ([] if key is None else [key]) + ["label", "segments"]
    first = 0 if key is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                cut_ = [segments(t) for t in part.column(first).to_pylist()]
                kept = pa.array([k for k, segs in enumerate(cut_) if segs], pa.int64())
                columns = [part.column(k).take(kept) for k in ([] if key is None else [0]) + [first + 1]]
                cells = pa.array([[dict(zip(("raw", "words", "n", "whole"), x, strict=True)) for x in segs] for segs in cut_ if segs], cell)
                yield pa.record_batch([*columns, cells], names=names)

    columns = ([] if key is None else [F.col(key)]) + ["text", "lang"]
    return cut(spread(df.select(*columns)).mapInArrow(run, f"{kind}label string, segments {SEGMENTS}"))


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in one row, and each text's bounds in it."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    c = _INDEX[np.minimum(codes, 0xFFFF)].astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    tri = c[:-2] * 65536 + c[1:-1] * 256 + c[2:] + 1
    return ((tri * np.uint64(2654435761)) >> np.uint64(13)).astype(np.int64) & (SIZE - 1), stops - sizes, stops - 2


class Models:
    """log of each hashed trigram's share in a language; one column per language."""

    def __init__(self, counts: np.ndarray):
        """Languages seen more often must not gain by it: shares first, then one smoothing for all."""
        for k, code in enumerate(LANGUAGES):
            h, *_ = hashes([f" {SEEDS[code]} "])
            np.add.at(counts[:, k], h, 1.0)
        share = counts / counts.sum(0, keepdims=True)
        self.table = np.log(0.98 * share + 0.02 / 20_000).astype(np.float32)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        tri, starts, stops = hashes(texts)
        sums = np.zeros((len(tri) + 1, len(LANGUAGES)))
        np.cumsum(self.table[tri], 0, dtype=np.float64, out=sums[1:])
        return sums[stops] - sums[starts]


def count(cut_: DataFrame, models: Models | None) -> np.ndarray:
    """Trigram counts per language over all segments: by label, or by what ``models`` say of each
    sentence. Added up per partition first; the result is bounded by the letters, not the corpus."""
    shared = cut_.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tri = np.zeros(len(LANGUAGES) * SIZE, np.int32)
        some = False
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                lists = part.column(1)
                cells = lists.flatten()
                n = cells.field("n").to_numpy()
                ok = n >= LEAST_WORDS
                if not ok.any():
                    continue
                some = True
                words = cells.field("words").filter(pa.array(ok)).to_pylist()
                if own is None:
                    code = [LANGUAGES.index(c) if (c := canonical(label)) in LANGUAGES else -1 for label in part.column(0).to_pylist()]
                    which = np.repeat(np.array(code), np.diff(lists.offsets.to_numpy()))[ok]
                else:
                    scores = own.likelihoods(words)
                    ranked = np.sort(scores, 1)
                    which = np.where(ranked[:, -1] - ranked[:, -2] > 5.0, scores.argmax(1), -1)
                h, starts, stops = hashes(words)
                owner = np.repeat(which, stops - starts + 2)[: len(h)]
                for edge in (stops[:-1], stops[:-1] + 1):  # trigrams that span two segments
                    owner[edge] = -1
                slot = owner * SIZE + h
                np.add.at(tri, slot[owner >= 0], 1)
        if some:
            at_ = np.flatnonzero(tri)
            yield pa.record_batch([pa.array((at_ // SIZE).astype(np.int32)), pa.array((at_ % SIZE).astype(np.int32)), pa.array(tri[at_].astype(np.int64))], names=["lang", "slot", "n"])

    rows = cut_.select("label", "segments").mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    tri = np.zeros((SIZE, len(LANGUAGES)))
    tri[rows["slot"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    return tri


def train(cut_: DataFrame) -> Models:
    """Models of the corpus, of the result of ``split``: two rounds, labels first, own judgement of each sentence second."""
    return Models(count(cut_, Models(count(cut_, None))))


def mixture(scores: np.ndarray, strong: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Languages of a document and their proportions. ``scores``: log likelihoods, a row per segment;
    ``strong``: segments long enough to bring in a language. Languages join one by one while the
    likelihood gains more than the penalty; proportions by expectation-maximisation. A document without a
    strong segment has the one language that fits it best."""
    base = int(scores.sum(0).argmax())
    chosen, share = [base], np.array([1.0])
    best = scores[:, base].sum()
    while len(chosen) < len(LANGUAGES) and strong.any():
        trial = []
        for lang in range(len(LANGUAGES)):
            if lang in chosen:
                continue
            gain = np.maximum(scores[strong, lang] - scores[strong][:, chosen].max(1), 0).sum()
            if gain > PENALTY:
                trial.append((gain, lang))
        if not trial:
            break
        group = [*chosen, max(trial)[1]]
        value, proportions = _fit(scores[:, group])
        if value - best <= PENALTY:
            break
        chosen, share, best = group, proportions, value
    if len(chosen) > 1:
        # A language that first won the whole may be left with nothing once others are in.
        owner = np.array(chosen)[scores[strong][:, chosen].argmax(1)]
        keep = [k for k, lang in enumerate(chosen) if (owner == lang).any()]
        chosen, share = [chosen[k] for k in keep], share[keep] / share[keep].sum()
    return chosen, share


def _fit(scores: np.ndarray) -> tuple[float, np.ndarray]:
    share = np.full(scores.shape[1], 1 / scores.shape[1])
    top = scores.max(1, keepdims=True)
    odds = np.exp(scores - top)
    for _ in range(20):
        post = odds * share
        post /= post.sum(1, keepdims=True)
        share = (post.sum(0) + 0.05) / (len(scores) + 0.05 * len(share))
    return float((np.log((odds * share).sum(1)) + top[:, 0]).sum()), share


def detect(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per segment with words: (key, label, segment, text, lang, confidence, lang_share, n_langs).

    Null, blank and wordless texts give no rows. A confidence is the posterior of the language among
    all ten, spread by segment length; ties fall to the language listed first in ``LANGUAGES``.
    Repeated rows are repeated. Only ``key``, ``text`` and ``lang`` are read, and each text is cut once."""
    cut_ = split(df, key)
    shared = df.sparkSession.sparkContext.broadcast(train(cut_))
    kind = df.schema[key].dataType.simpleString()
    names = [key, "label", "segment", "text", "lang", "confidence", "lang_share", "n_langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                lists = part.column(2)
                cells = lists.flatten()
                words = cells.field("words").to_pylist()
                s = own.likelihoods(words)
                n, whole = cells.field("n").to_numpy(), cells.field("whole").to_numpy(zero_copy_only=False)
                strong = whole & (n >= LEAST_WORDS) & (np.array([len(w) for w in words]) - n - 1 >= LEAST_LETTERS)
                # Trigrams of a text overlap, so the odds are tempered before they are read as a posterior.
                soft = np.exp((s - s.max(1, keepdims=True)) / 3)
                soft /= soft.sum(1, keepdims=True)
                sizes = np.diff(lists.offsets.to_numpy())
                lang, share, langs = np.zeros(len(s), np.int64), np.zeros(len(s)), np.zeros(len(s), np.int32)
                a = 0
                for size in sizes:
                    b = a + size
                    if size == 1:
                        lang[a], share[a], langs[a] = s[a].argmax(), 1.0, 1
                    else:
                        chosen, parts = mixture(s[a:b], strong[a:b])
                        best = s[a:b, chosen].argmax(1)
                        lang[a:b], share[a:b], langs[a:b] = np.array(chosen)[best], parts[best], len(chosen)
                    a = b
                doc = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                order = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [pa.array(order.astype(np.int32)), cells.field("raw"), pa.array(LANGUAGES).take(pa.array(lang)), pa.array(soft[np.arange(len(s)), lang]), pa.array(share), pa.array(langs)]
                yield pa.record_batch([part.column(0).take(doc), part.column(1).take(doc), *columns], names=names)

    schema = f"`{key}` {kind}, label string, segment int, text string, lang string, confidence double, lang_share double, n_langs int"
    return cut_.mapInArrow(run, schema)


def _label_code():  # noqa: ANN202
    forms = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    text = F.lower(F.trim("label"))
    head = F.regexp_extract(text, r"^([^\-_\s(]*)", 1)
    return F.when(text.isNull() | text.isin(*MISSING), None).otherwise(F.coalesce(forms[text], forms[head], F.lit("other")))


def per_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, label_code, lang, lang_share, confidence, n_langs): one row per language of a document."""
    found = detect(df, key)
    by = found.groupBy(key, "label", "lang", "n_langs").agg(F.max("lang_share").alias("lang_share"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_segments"))
    return by.withColumn("label_code", _label_code())


def found(df: DataFrame) -> DataFrame:
    """Languages of documents that are mixed, or whose label is missing or names another language."""
    docs = per_document(df)
    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("lang"))
    return docs.where((F.col("n_langs") > 1) | wrong).select("doc_id", "lang").distinct()
