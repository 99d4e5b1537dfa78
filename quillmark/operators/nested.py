"""Deeply nested records as flat related tables.

Every array level and every object becomes rows of a child table: one narrow pass explodes each payload
recursively, and each row carries its own surrogate key, its parent's key, the array ordinal it stands
at and its full path. The merged schema (a distributed aggregate of table, field and type over all
rows; objects with names for keys are folded into one table) types the child tables, so a new key or
list gets its column or table without a change here.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Collection, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.session import spread

OBJECT_KEYS = ("stats", "posted_at", "reshared_post")
LIST_KEYS = ("experience", "roles")
NODE_SCHEMA = "node_key string, parent_key string, parent_kind string, kind string, name string, path string, ordinal int, depth int, n_keys int, body string"
#: An object of more distinct keys over all rows holds names for keys: its members are rows of one table.
MAP_KEYS = 50
#: Digits up to which a whole number is read as such; longer ones keep their text.
DIGITS = 4000


def _reject(token: str) -> None:
    raise ValueError(token)


def _whole(digits: str) -> int | str:
    return int(digits) if len(digits) <= DIGITS else digits


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"null": None, "true": True, "false": False}


def parse_deep(text: str) -> object:
    """JSON of any depth: open objects and lists are held on a stack of our own."""
    at = lambda i: _BLANK.match(text, i).end()
    stack: list[tuple[dict | list, str | None]] = []
    i = at(0)
    while True:
        opened = text[i : i + 1]
        if opened in ("{", "["):
            value: object = {} if opened == "{" else []
            i = at(i + 1)
            if text[i : i + 1] != ("}" if opened == "{" else "]"):
                stack.append((value, None))
                if opened == "{":
                    i = _key(text, i, stack, at)
                continue
            i += 1
        elif opened == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = (float(m[0]) if m[1] or m[2] else _whole(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(i)
            value, i = _WORDS[word], i + len(word)
        while stack:  # the value is complete: put it where it belongs, and close what ends here
            held, key = stack[-1]
            if isinstance(held, dict):
                held[key] = value
            else:
                held.append(value)
            i = at(i)
            sign = text[i : i + 1]
            if sign == ",":
                i = at(i + 1)
                if isinstance(held, dict):
                    stack.pop()
                    stack.append((held, None))
                    i = _key(text, i, stack, at)
                break
            if sign != ("}" if isinstance(held, dict) else "]"):
                raise ValueError(i)
            stack.pop()
            value, i = held, i + 1
        else:
            if at(i) != len(text):
                raise ValueError(i)
            return value


def _key(text: str, i: int, stack: list, at) -> int:  # noqa: ANN001
    """Reads ``"key":`` for the object on top and gives the place of its value."""
    if text[i : i + 1] != '"':
        raise ValueError(i)
    key, i = scanstring(text, i + 1, True)
    i = at(i)
    if text[i : i + 1] != ":":
        raise ValueError(i)
    stack[-1] = (stack[-1][0], key)
    return at(i + 1)


def parse_payload(text: str | None) -> tuple[bool, object]:
    """Whether it is valid JSON (NaN and Infinity are not), and its value; neither depth nor digits are bounded."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_reject, parse_int=_whole)
    except ValueError:
        return False, None
    except RecursionError:
        try:
            return True, parse_deep(text)
        except ValueError:
            return False, None


def as_object(value: object) -> object:
    """An object delivered as text (JSON, or a literal with single quotes) counts as the object."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] == "{" and text[-1:] == "}":
            ok, parsed = parse_payload(text)
            if not ok:
                try:
                    parsed = ast.literal_eval(text)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    return value
            if isinstance(parsed, dict):
                return parsed
    return value


def node_key(record: str, path: str) -> str:
    return hashlib.blake2b(f"{record}\x00{path}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def walk(record: str, root: object, objects: Collection[str] = OBJECT_KEYS, lists: Collection[str] = LIST_KEYS) -> Iterator[tuple]:
    """All rows of one payload, parents before children; an explicit stack, so depth is no limit.

    Each object is a row of the table of the key it stands under, each element of a list a row of the list's
    table (objects with their fields, other elements with ``value``; a list within a list is the table
    ``key[]``). The parent is the object around it. Elements are numbered over all elements. Under ``objects``
    and in ``lists``, an object delivered as text counts as the object, and a single object in place of a list
    is element 0. Empty objects are rows without fields."""
    # (value, path, table, key, ordinal, parent key, parent table, depth)
    stack: list[tuple] = [(root, "", "root", None, None, None, None, 0)]
    while stack:
        value, path, table, name, ordinal, parent, parent_table, depth = stack.pop()
        if table in (objects if ordinal is None else lists):
            value = as_object(value)
        if isinstance(value, list):
            table_of = table if name is None and ordinal is None else f"{table}[]"
            stack += [(item, f"{path}[{k}]", table_of, None, k, parent, parent_table, depth) for k, item in enumerate(value)]
            continue
        own = node_key(record, path)
        fields = value if isinstance(value, dict) else {"value": value}
        scalars = {}
        for key, item in fields.items():
            below = f"{path}.{key}" if path else key
            if key in lists and isinstance(item := as_object(item), dict):
                stack.append((item, f"{below}[0]", key, None, 0, own, table, depth + 1))
            elif isinstance(item, list):
                stack += [(x, f"{below}[{k}]", key, None, k, own, table, depth + 1) for k, x in enumerate(item)]
            elif isinstance(item, dict) or (key in objects and isinstance(as_object(item), dict)):
                stack.append((item, below, key, key, None, own, table, depth + 1))
            else:
                scalars[key] = item
        yield own, parent, parent_table, table, name, path, ordinal, depth, len(value) if isinstance(value, dict) else 0, scalars


def nodes(df: DataFrame, key: str = "record_id", payload: str = "payload", tables: tuple[str, ...] | None = None, objects: tuple[str, ...] = OBJECT_KEYS, lists: tuple[str, ...] = LIST_KEYS) -> DataFrame:
    """Rows of every payload with ``key`` in front; only those of ``tables``, if given.

    Null, empty and invalid payloads give nothing. Repeated records give equal rows each time; a
    null ``key`` is kept as null. Only ``key`` and ``payload`` are read, so other columns can't clash.
    """
    schema = T.StructType([df.schema[key], *T._parse_datatype_string(NODE_SCHEMA).fields])
    names = [f.name for f in schema.fields]
    kinds = [pa.string()] * 6 + [pa.int32()] * 3 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, source, out = batch.column(0), [], []
            for at, (record, text) in enumerate(zip(keys.to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ok, root = parse_payload(text)
                if not ok:
                    continue
                for node in walk(str(record), root, objects, lists):
                    if tables is None or node[3] in tables:
                        source.append(at)
                        out.append((*node[:9], json.dumps(node[9], ensure_ascii=False)))
                if len(out) >= BLOCK:
                    yield _block(keys, source, out, kinds, names)
                    source, out = [], []
            yield _block(keys, source, out, kinds, names)

    return spread(df.select(key, payload)).mapInArrow(run, schema)


#: Rows handed over together, so one payload of very many objects does not fill a batch's memory twice.
BLOCK = 50_000


def _block(keys: pa.Array, source: list[int], out: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
    arrays = [pa.array([_clean(x) for x in c] if t == pa.string() else c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.record_batch([keys.take(pa.array(source, pa.int64())), *arrays], names=names)


def _clean(text: str | None) -> str | None:
    """Lone surrogates of a JSON escape have no UTF-8 form; they become U+FFFD."""
    return text if text is None else text.encode("utf-8", "replace").decode() if not text.isascii() else text


def folded(node_rows: DataFrame) -> DataFrame:
    """The rows with members of objects that hold names for keys as one table ``<object>.*``; ``name`` keeps the key."""
    wide = node_rows.where("name IS NOT NULL").groupBy("parent_kind").agg(F.approx_count_distinct("kind").alias("n")).where(F.col("n") > MAP_KEYS)
    marked = node_rows.join(wide.select(F.col("parent_kind").alias("map_kind"), F.lit(True).alias("is_map")), F.col("parent_kind") == F.col("map_kind"), "left")
    kind = F.when(F.col("is_map") & F.col("name").isNotNull(), F.concat("parent_kind", F.lit(".*"))).otherwise(F.col("kind"))
    return marked.withColumn("kind", kind).select(*node_rows.columns)


def merged_schema(node_rows: DataFrame) -> DataFrame:
    """(kind, field, type, n_values) over all rows: BIGINT if every value is a whole number that fits, else DOUBLE,
    BOOLEAN or STRING. One aggregate; its size is the number of distinct fields, not of rows."""
    cell = node_rows.select("kind", F.explode(F.from_json("body", "map<string,string>")).alias("field", "value")).where("value IS NOT NULL")
    whole = F.col("value").rlike(r"^-?[0-9]{1,18}$")
    real = F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    flag = F.col("value").isin("true", "false")
    return cell.groupBy("kind", "field").agg(
        F.when(F.every(whole), "BIGINT").when(F.every(real), "DOUBLE").when(F.every(flag), "BOOLEAN").otherwise("STRING").alias("type"),
        F.count("*").alias("n_values"),
    )


def child_table(node_rows: DataFrame, kind: str, fields: dict[str, str], key: str = "record_id") -> DataFrame:
    """The flat table of one kind: keys, ordinal and path, then one column per field of the merged schema."""
    cells = F.from_json("body", "map<string,string>")
    own = (key, "node_key", "parent_key", "parent_kind", "name", "ordinal", "path")
    columns = []
    for field, type_ in sorted(fields.items()):
        cell = F.try_element_at("cells", F.lit(field))
        columns.append((cell if type_ == "STRING" else cell.try_cast(type_.lower())).alias(f"field_{field}" if field.lower() in own else field))
    return node_rows.where(F.col("kind") == kind).withColumn("cells", cells).select(*own, *columns)


def child_tables(node_rows: DataFrame, key: str = "record_id") -> dict[str, DataFrame]:
    """Every kind's flat table under the merged schema (collected: one row per distinct field)."""
    fields: dict[str, dict[str, str]] = {}
    for row in merged_schema(node_rows).collect():
        fields.setdefault(row["kind"], {})[row["field"]] = row["type"]
    return {kind: child_table(node_rows, kind, cols, key) for kind, cols in fields.items()}


def table_of(df: DataFrame, kind: str, key: str = "record_id") -> DataFrame:
    """One child table, typed by the merged schema of its rows; a table nobody fills has its key columns only."""
    rows = nodes(df, key, tables=(kind,))
    return child_table(rows, kind, {r["field"]: r["type"] for r in merged_schema(rows).collect()}, key)


def found_paths(df: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, path) of the rows with at least one key in the child tables of the named keys: objects that stand under
    one of ``OBJECT_KEYS``, and elements of lists under one of ``LIST_KEYS``."""
    rows = nodes(df, key, tables=(*OBJECT_KEYS, *LIST_KEYS)).where("n_keys > 0")
    named = F.col("kind").isin(*OBJECT_KEYS) & F.col("ordinal").isNull() | F.col("kind").isin(*LIST_KEYS) & F.col("ordinal").isNotNull()
    return rows.where(named).select(key, "path").distinct()
