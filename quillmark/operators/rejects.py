"""Loading delimited records and setting apart those that cannot be loaded, each with its reason.

Reasons, first that applies:

* ``quoting`` - a double quote stands where RFC 4180 allows none, or a quoted field never closes;
* ``column_count`` - the record has not exactly one field per column, or is more than one record;
* ``bad_value`` - a cell fails its column's rule.

Structure is judged by the Arrow CSV reader over whole batches (its invalid-row callback names the
rejected rows), values by casts and matches over whole columns. No row is handled on its own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.session import spread

QUOTED = r'"(?:[^"]|"")*"'
#: One RFC 4180 record; RE2 decides it in linear time, so the length of a text does not matter.
RECORD = rf'^(?s:(?:{QUOTED}|[^"\r\n,]*)(?:,(?:{QUOTED}|[^"\r\n,]*))*)$'
#: As above, but line breaks may stand anywhere: tells broken quoting from several records in one.
RECORDS = rf'^(?s:(?:{QUOTED}|[^",\r\n]*)(?:(?:,|\r\n|\r|\n)(?:{QUOTED}|[^",\r\n]*))*)$'

GOOD, REJECTED = "ok", "rejected"


@dataclass(frozen=True)
class Rule:
    """What a cell must look like. ``kind``: digits (ASCII, may be empty), timestamp (format
    ``yyyy-MM-dd HH:mm:ss``, may be empty), prefix (begins with ``arg``), one_of (``arg`` values)."""

    kind: str
    arg: tuple[str, ...] = ()


@dataclass(frozen=True)
class RecordSpec:
    columns: tuple[str, ...]
    rules: dict[str, Rule] = field(default_factory=dict)


COUNTS = ("reactions_total", "likes", "comments", "reposts", "celebrates", "supports", "loves", "insights", "funnys")
POST_COLUMNS = (
    "company_name", "person_name", "position", "source", "gvkey", "ticker", "execid", "person_name_clean",
    "company_name_clean", "profile_url", "post_text", "post_url", "post_type", "post_date", "post_timestamp",
    "author_name", "author_headline", *COUNTS, "media_type", "article_url", "article_title", "reshared_text",
    "reshared_url", "reshared_author",
)
POSTS = RecordSpec(
    POST_COLUMNS,
    {
        "post_date": Rule("timestamp"),
        "post_timestamp": Rule("digits"),
        **{c: Rule("digits") for c in COUNTS},
        "profile_url": Rule("prefix", ("https://example.com/in/",)),
        "post_type": Rule("one_of", ("regular", "repost", "quote", "article")),
    },
)


def _fails(cells: pa.ChunkedArray, rule: Rule) -> pa.ChunkedArray:
    if rule.kind == "digits":
        return pc.invert(pc.match_substring_regex(cells, r"^[0-9]*$"))
    if rule.kind == "prefix":
        return pc.invert(pc.starts_with(cells, rule.arg[0]))
    if rule.kind == "one_of":
        return pc.invert(pc.is_in(cells, value_set=pa.array(rule.arg)))
    if rule.kind == "timestamp":
        shaped = pc.match_substring_regex(cells, r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
        return pc.invert(pc.or_(pc.equal(cells, ""), pc.and_(shaped, _real_time(cells))))
    raise ValueError(rule.kind)


def _real_time(cells: pa.ChunkedArray) -> pa.ChunkedArray:
    """Whether fixed-width digits name a moment of the calendar; unshaped cells give false."""
    digits = pc.match_substring_regex(cells, r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    safe = pc.if_else(digits, cells, "0000-00-00 00:00:00")
    part = {
        name: pc.cast(pc.utf8_slice_codeunits(safe, a, b), pa.int32())
        for name, a, b in (("y", 0, 4), ("m", 5, 7), ("d", 8, 10), ("h", 11, 13), ("n", 14, 16), ("s", 17, 19))
    }
    year, month = part["y"], part["m"]
    divisible = lambda n: pc.equal(pc.subtract(year, pc.multiply(pc.divide(year, n), n)), 0)
    leap = pc.or_(pc.and_(divisible(4), pc.invert(divisible(100))), divisible(400))
    short = pc.is_in(month, value_set=pa.array([4, 6, 9, 11], pa.int32()))
    days = pc.if_else(pc.equal(month, 2), pc.if_else(leap, 29, 28), pc.if_else(short, 30, 31))
    ok = pc.and_(pc.greater_equal(year, 1), pc.and_(pc.greater_equal(month, 1), pc.less_equal(month, 12)))
    ok = pc.and_(ok, pc.and_(pc.greater_equal(part["d"], 1), pc.less_equal(part["d"], days)))
    return pc.and_(ok, pc.and_(pc.less(part["h"], 24), pc.and_(pc.less(part["n"], 60), pc.less(part["s"], 60))))


def _parse(keys: pa.Array, texts: pa.Array, spec: RecordSpec) -> tuple[pa.Table, list[int]]:
    """Records of sound quoting, read in one go with their position as first field; the callback
    collects the positions of those with another number of fields."""
    rejected: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(int(row.text.split(",", 1)[0]))
        return "skip"

    names = ["__at", *spec.columns]
    buffer = io.BytesIO()
    for at, text in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
        buffer.write(f"{at},".encode() + text.encode("utf-8", "surrogatepass") + b"\n")
    data = buffer.getvalue()
    if not data:
        return pa.table({n: pa.array([], pa.int64() if n == "__at" else pa.string()) for n in names}), rejected
    read = pacsv.read_csv(
        pa.BufferReader(data),
        # One block, so a record is never split and callbacks come in order.
        read_options=pacsv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(
            column_types={n: pa.int64() if n == "__at" else pa.string() for n in names},
            strings_can_be_null=False,
        ),
    )
    return read, rejected


def classify(texts: pa.Array, spec: RecordSpec) -> pa.Table:
    """One row per text, in order: ``reason`` (null if it loads), ``failing`` cells, then the columns."""
    n = len(texts)
    # The line break that ends a record is no part of it.
    texts = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), r"(?:\r\n|\r|\n)$", "")
    one = pc.match_substring_regex(texts, RECORD)
    sound = pc.match_substring_regex(texts, RECORDS)  # several records in one are no quoting fault
    reason: list[str | None] = [None if a else "column_count" if b else "quoting" for a, b in zip(one.to_pylist(), sound.to_pylist(), strict=True)]
    at = pa.array(range(n), pa.int64())
    parsed, rejected = _parse(at.filter(one), texts.filter(one), spec)
    for k in rejected:
        reason[k] = "column_count"
    failing: list[list[str]] = [[] for _ in range(n)]
    where = parsed["__at"].to_pylist()
    for name, rule in spec.rules.items():
        bad = _fails(parsed[name], rule)
        for k in parsed["__at"].filter(bad).to_pylist():
            failing[k].append(name)
    for k in where:
        if failing[k]:
            reason[k] = "bad_value"
    back = pa.array(_positions(where, n), pa.int64())
    columns = {c: pc.take(parsed[c].combine_chunks(), back) for c in spec.columns}
    return pa.table({"reason": pa.array(reason, pa.string()), "failing": pa.array(failing, pa.list_(pa.string())), **columns})


def _positions(where: list[int], n: int) -> list[int | None]:
    back: list[int | None] = [None] * n
    for k, w in enumerate(where):
        back[w] = k
    return back


def load_records(df: DataFrame, spec: RecordSpec = POSTS, text: str = "line_text") -> DataFrame:
    """All rows of ``df`` with ``reason``, ``failing`` and one string column per field.

    ``reason`` is null for a record that loads. Null and empty texts are one empty field
    (``column_count``). Equal rows are judged alike and all kept. Columns of ``df`` that bear a
    field's name are kept as ``in_<name>``. An empty input gives an empty result. One narrow pass:
    nothing is shuffled, but for an input of too few splits (see ``spread``).
    """
    fields = ("reason", "failing", *spec.columns)
    clash = {c.lower() for c in fields}
    kept = df.withColumnsRenamed({c: f"in_{c}" for c in df.columns if c.lower() in clash})
    text = f"in_{text}" if text.lower() in clash else text
    schema = T.StructType([*kept.schema.fields, T.StructField("reason", T.StringType()), T.StructField("failing", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in spec.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = classify(batch.column(text), spec)
            merged = pa.table([*batch.columns, *(c.combine_chunks() for c in out.columns)], names=[*batch.schema.names, *out.column_names])
            yield from merged.to_batches()

    return spread(kept).mapInArrow(run, schema)


def typed(df: DataFrame, spec: RecordSpec = POSTS) -> DataFrame:
    """Loaded records with counts as BIGINT and dates as TIMESTAMP; empty cells become null."""
    def cast(name: str) -> Column:
        cell = F.nullif(F.col(name), F.lit(""))
        rule = spec.rules.get(name)
        if rule and rule.kind == "digits":
            return F.expr(f"try_cast(nullif(`{name}`, '') AS BIGINT)").alias(name)
        if rule and rule.kind == "timestamp":
            return F.expr(f"try_to_timestamp(nullif(`{name}`, ''), 'yyyy-MM-dd HH:mm:ss')").alias(name)
        return cell.alias(name)

    keep = [c for c in df.columns if c not in spec.columns and c not in ("reason", "failing")]
    return df.where("reason IS NULL").select(*keep, *(cast(c) for c in spec.columns))


def rejects(df: DataFrame, key: str = "line_id") -> DataFrame:
    """``key`` and ``reason`` of the records that do not load."""
    return df.where("reason IS NOT NULL").select(key, "reason").distinct()
