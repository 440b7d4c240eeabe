"""Deeply nested records to flat, linked tables.

Each record is parsed as a stream of path-value-ordinal triples; paths are grouped by the repeated ancestor
they hang from; each group pivots into one table whose rows are linked to their parent object and record.

JSON columns (strings) and typed columns (structs, arrays) take the same way: typed ones are written as JSON
on the JVM side. Results: a null column, a string that is no valid JSON and an empty array give no triples; JSON
encoded twice is decoded; null array elements count for ordinals and give no row; an array within an array
gives two ordinals; NaN and Infinity aren't valid JSON; numbers keep the text they have. Repeated rows count
once. Depth is not limited. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.session import cut, spread


_TOKEN = re.compile(r'[ \t\r\n]*([{}\[\],:]|"[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)')
_KINDS = {"t": "boolean", "f": "boolean"}

Triple = tuple[str, str, str, list[int], str, str | None, str]


class _Open:
    """An open container: where it is, and what comes next in it."""

    __slots__ = ("listed", "group", "elem", "parent", "field", "ords", "above", "place", "key", "begin", "seen")

    def __init__(self, listed: bool, group: str, elem: str, parent: str, field: str, ords: tuple[int, ...], above: str):
        self.listed, self.group, self.elem, self.parent, self.field, self.ords, self.above = listed, group, elem, parent, field, ords, above
        self.place, self.key, self.begin, self.seen = -1, "", 0, {}


def _unescaped(token: str) -> str:
    """The string that a token stands for; half a surrogate pair becomes the replacement character."""
    return json.loads(token).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def triples(text: str | None, column: str, decode_twice: bool = True) -> list[Triple]:
    """(group_path, elem_path, parent_path, ordinals, field, value, kind) of each leaf, and one of kind "object" for each element object.

    The text is read token by token with a stack of the open containers; no record is built. group_path is elem_path
    with its ordinals left out. field is the path from the element to the leaf; arrays of plain values are leaves one
    by one, with the ordinal in the field. Text that is no valid JSON has none; of a key that an object has twice the
    last value counts.
    """
    if text is None:
        return []
    try:
        return _stream(text, column, decode_twice)
    except ValueError:
        return []


def _stream(text: str, column: str, decode_twice: bool) -> list[Triple]:
    out: list[Triple | None] = []
    stack: list[_Open] = []
    match, at, end = _TOKEN.match, 0, len(text.rstrip(" \t\r\n"))
    state, replaced = "value", False  # value, value or end, key, key or end, colon, next
    while at < end:
        m = match(text, at)
        if m is None:
            raise ValueError(at)
        tok, at = m.group(1), m.end()
        first = tok[0]
        if state == "next":
            if not stack:
                raise ValueError(at)
            top = stack[-1]
            if first == ",":
                state = "value" if top.listed else "key"
                if not top.listed:
                    top.seen[top.key] = (top.begin, len(out))
            elif first == ("]" if top.listed else "}"):
                stack.pop()
            else:
                raise ValueError(at)
            continue
        if state == "colon":
            if first != ":":
                raise ValueError(at)
            state = "value"
            continue
        if state == "key" or state == "key or end":
            if first == "}" and state == "key or end":
                stack.pop()
                state = "next"
                continue
            if first != '"':
                raise ValueError(at)
            top = stack[-1]
            top.key = tok[1:-1] if "\\" not in tok else _unescaped(tok)
            if top.key in top.seen:  # the earlier value of a repeated key
                x, y = top.seen[top.key]
                out[x:y] = [None] * (y - x)
                replaced = True
            top.begin = len(out)
            state = "colon"
            continue
        if first == "]" and state == "value or end":
            stack.pop()
            state = "next"
            continue
        if first in "}],:":
            raise ValueError(at)
        # a value, at the place that the open container gives
        if not stack:
            if first == '"' and decode_twice:
                if at != end:
                    raise ValueError(at)
                return _stream(_unescaped(tok), column, False)
            group, elem, parent, field, ords, above = column, column, "", "", (), ""
        else:
            top = stack[-1]
            group, elem, parent, ords, above = top.group, top.elem, top.parent, top.ords, top.above
            if top.listed:
                top.place += 1
                base = f".{top.field}" if top.field else ""
                if first == "{":
                    group, elem, parent, ords = f"{group}{base}[]", f"{elem}{base}[{top.place}]", above, (*ords, top.place)
                    field, above = "", elem
                    out.append((group, elem, parent, list(ords), "", None, "object"))
                elif first == "[":
                    group, elem, field, ords = f"{group}{base}[]", f"{elem}{base}[{top.place}]", "", (*ords, top.place)
                else:
                    field = f"{top.field}[{top.place}]"
            else:
                field = f"{top.field}.{top.key}" if top.field else top.key
        if first == "{" or first == "[":
            stack.append(_Open(first == "[", group, elem, parent, field, ords, above))
            state = "value or end" if first == "[" else "key or end"
            continue
        state = "next"
        if tok == "null":
            continue
        if first == '"':
            out.append((group, elem, parent, list(ords), field, tok[1:-1] if "\\" not in tok else _unescaped(tok), "string"))
        else:
            out.append((group, elem, parent, list(ords), field, tok, _KINDS.get(first, "number")))
    if stack or state != "next":
        raise ValueError("cut off")
    return [t for t in out if t is not None] if replaced else out


def objects(text: str | None, column: str) -> list[tuple[str, str]]:
    """(elem_path, parent_path) of each object that is an element of an array."""
    return [(t[1], t[2]) for t in triples(text, column) if t[6] == "object"]


def _as_json(df: DataFrame, columns: list[str]):
    for c in columns:
        kind = df.schema[c].dataType
        yield F.col(c) if isinstance(kind, T.StringType) else F.to_json(F.col(c)).alias(c)


#: So many repeated keys, at most, are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def nested_triples(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, group_path, elem_path, parent_path, ordinals, field, value, kind): all triples of all records, each once.

    Only the keys are shuffled to find the repeated ones; the triples of their rows are made distinct, those of all
    other rows come straight from the scan.
    """
    kind = dict(df.dtypes)[key]
    typed = {c: not isinstance(df.schema[c].dataType, T.StringType) for c in columns}
    names = ("group_path", "elem_path", "parent_path", "ordinals", "field", "value", "kind")
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                at, out = [], []
                for i, c in enumerate(columns):
                    for row, text in enumerate(part.column(i + 1).to_pylist()):
                        got = triples(text, c, not typed[c])
                        at += [row] * len(got)
                        out += got
                cols = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(v), t) for v, t in zip(cols, types)]], [key, *names])

    schema = f"`{key}` {kind}, group_path string, elem_path string, parent_path string, ordinals array<int>, field string, value string, kind string"
    again = cut(df.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again"))
    again = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    same = F.col(key).eqNullSafe(F.col("_again"))
    made = lambda how: spread(df.select(key, *columns), key).join(again, same, how).select(key, *_as_json(df, columns)).mapInArrow(run, schema)
    return made("left_anti").unionByName(made("left_semi").distinct())


def group_fields(found: DataFrame) -> DataFrame:
    """(group_path, field, n): the fields each table would have, over all records; array ordinals in fields left out."""
    return found.filter("kind <> 'object'").groupBy("group_path", F.regexp_replace("field", r"\[\d+\]", "[]").alias("field")).agg(F.count("*").alias("n"))


def element_objects(found: DataFrame, key: str) -> DataFrame:
    """(key, elem_path, parent_path): one row for each object in an array, from the triples of kind object."""
    return found.filter("kind = 'object'").select(key, "elem_path", "parent_path")


def nested_tables(found: DataFrame, key: str) -> dict[str, DataFrame]:
    """One pivoted table for each group path, with the fields that group_fields finds; those of records themselves have no ordinal.

    A group whose objects have no plain field gives a table of its elements alone. Plain arrays are fields with the
    ordinals left out, whose values stand in an array in their order.
    """
    found = cut(found)
    fields = group_fields(found).select("group_path", "field").unionByName(found.filter("kind = 'object'").select("group_path", F.lit(None).cast("string").alias("field"))).distinct()
    groups: dict[str, list[str]] = {}
    for group, f in fields.collect():
        groups.setdefault(group, []).extend([f] if f is not None else [])
    return {group: nested_table(found, key, group, sorted(fs)) for group, fs in sorted(groups.items())}


def nested_table(found: DataFrame, key: str, group_path: str, fields: list[str]) -> DataFrame:
    """One flat table of a group: key, elem_path, parent_path, ordinal and the named fields (null where absent)."""
    own = found.filter(F.col("group_path") == group_path)
    names = column_names(fields, key)
    pick = [_picked(f).alias(names[f]) for f in fields]
    return own.groupBy(key, "elem_path", "parent_path", F.try_element_at("ordinals", F.lit(-1)).alias("ordinal")).agg(F.count("*").alias("_n"), *pick).drop("_n")


def column_names(fields: list[str], key: str) -> dict[str, str]:
    """Column of each field: dots and brackets give way to underscores; where two would be the same, ignoring case, a later one gets a number."""
    out: dict[str, str] = {}
    used = {key.lower(), "elem_path", "parent_path", "ordinal", "_n"}
    for f in fields:
        base = name = f.replace("[]", "").replace(".", "_") or "value"
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out[f] = name
    return out


def _picked(f: str):
    """The value of a field; of one with arrays in its path, all values by their places."""
    if "[]" not in f:
        return F.max(F.when(F.col("field") == f, F.col("value")))
    here = F.regexp_replace("field", r"\[\d+\]", "[]") == f
    places = F.transform(F.regexp_extract_all("field", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.transform(F.array_sort(F.collect_list(F.when(here, F.struct(places.alias("at"), F.col("value"))))), lambda x: x["value"])
