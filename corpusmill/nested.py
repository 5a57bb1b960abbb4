"""Problem 3: deeply nested semi-structured records as related flat tables.

Method: stream-parse each record into path-value-ordinal triples, group the paths by their repeated ancestor, and pivot
each group into one table. A pull parser (no recursion, no tree) walks the JSON text once; a declared path says which
containers repeat. The triples of one repeated ancestor come out of the parser one after another, so they are grouped and
pivoted within the record: no shuffle. Every row carries its parent's keys (record id and the outer ordinals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?").match
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


class Incomplete(ValueError):
    """The text is not one complete JSON value."""


def events(text: str) -> Iterator[tuple[str, object]]:
    """Pull parser: ("{" | "}" | "[" | "]", None), ("key", name), ("value", scalar). Memory: one bit of state per open
    container. Raises Incomplete where the text is not exactly one JSON value."""
    i, open_, n = _SPACE(text, 0).end(), [], len(text)
    want = "value"  # value, first (value or close), key, first-key (key or close), after
    while True:
        if i >= n:
            if want == "after" and not open_:
                return
            raise Incomplete("ends early")
        c = text[i]
        if want in ("value", "first"):
            if want == "first" and c == "]":
                yield "]", None
                open_.pop()
                i, want = i + 1, "after"
            elif c == "{":
                yield "{", None
                open_.append("}")
                i, want = i + 1, "first-key"
            elif c == "[":
                yield "[", None
                open_.append("]")
                i, want = i + 1, "first"
            else:
                if c == '"':
                    try:
                        value, i = scanstring(text, i + 1, True)
                    except ValueError as e:
                        raise Incomplete(str(e)) from None
                elif c in _WORDS and text.startswith(_WORDS[c][0], i):
                    value, i = _WORDS[c][1], i + len(_WORDS[c][0])
                elif m := _NUMBER(text, i):
                    value, i = m[0], m.end()
                else:
                    raise Incomplete(f"unexpected {c!r}")
                yield "value", value
                want = "after"
        elif want in ("key", "first-key"):
            if want == "first-key" and c == "}":
                yield "}", None
                open_.pop()
                i, want = i + 1, "after"
            elif c == '"':
                try:
                    name, i = scanstring(text, i + 1, True)
                except ValueError as e:
                    raise Incomplete(str(e)) from None
                i = _SPACE(text, i).end()
                if text[i : i + 1] != ":":
                    raise Incomplete("no colon")
                yield "key", name
                i, want = i + 1, "value"
            else:
                raise Incomplete(f"unexpected {c!r}")
        elif not open_:
            raise Incomplete("text after the end")
        elif c == ",":
            i, want = i + 1, "key" if open_[-1] == "}" else "value"
        elif c == open_[-1]:
            yield c, None
            open_.pop()
            i += 1
        else:
            raise Incomplete(f"unexpected {c!r}")
        i = _SPACE(text, i).end()


@dataclass(frozen=True)
class Table:
    """A flat table to take out of nested records.

    path: names from the record down to the rows of the table; one that ends in "[]" repeats, and gives an ordinal.
    bare: the column a bare string takes in place of the row object, if one may.
    fields: column name -> dotted path below the row; ``bare_fields``: an inner object that may be a bare string, and
    the path that string stands for.
    """

    name: str
    path: tuple[str, ...]
    fields: dict[str, str]
    bare: str | None = None
    bare_fields: dict[str, str] | None = None

    @property
    def depth(self) -> int:
        return sum(p.endswith("[]") for p in self.path)


def _looks_like(text: str) -> bool:
    return text.startswith("{", _SPACE(text, 0).end())


def triples(text: str, lists: frozenset[tuple[str, ...]], objects: frozenset[tuple[str, ...]]) -> list[tuple[tuple[str, ...], tuple[int, ...], object]]:
    """(path, ordinals, value) of a record, in order. lists: declared paths that repeat; objects: declared paths at
    which JSON text of an object stands for that object. Lists elsewhere repeat too, under a path part "[]".

    A bare object or value where a list is declared is a list of one. A one-element list around the record is the
    record; a longer one gives nothing. Null entries of a list take an ordinal and give a triple with value None at the
    entry's own path. A text that isn't complete JSON gives nothing (an empty list)."""
    out: list[tuple[tuple[str, ...], tuple[int, ...], object]] = []
    try:
        _walk(events(text), (), (), lists, objects, out, True)
    except Incomplete:
        return []
    return out


def _walk(stream, path, at, lists, objects, out, top) -> None:
    """One pass over the events with an explicit stack of [closing mark, path, ordinals, next ordinal]."""
    stack: list[list] = []
    name = None  # the path of the next value, if it was named by a key

    def where() -> tuple[tuple[str, ...], tuple[int, ...]]:
        """Path and ordinals of the value that begins now."""
        nonlocal name
        if not stack:
            return path, at
        frame = stack[-1]
        if frame[0] == "]":
            frame[3] += 1
            if frame[1] is None:  # the list around the record
                return path, at
            return frame[1], (*frame[2], frame[3] - 1)
        p, name = (*frame[1], name), None
        return p, frame[2]

    for kind, value in stream:
        if kind == "key":
            name = value
        elif kind == "{":
            p, o = where()
            listed = not stack or stack[-1][0] == "]"
            if p in lists and not listed:  # a bare object: a list of one
                o = (*o, 0)
            stack.append(["}", p, o, 0])
        elif kind == "[":
            if not stack and top:
                stack.append(["]", None, (), 0])
                continue
            p, o = where()
            if stack and stack[-1][0] == "]" and stack[-1][1] is not None or p not in lists:
                p = (*p, "[]")
            stack.append(["]", p, o, 0])
        elif kind in ("}", "]"):
            frame = stack.pop()
            if frame[0] == "]" and frame[1] is None and frame[3] != 1:
                out.clear()
                raise Incomplete("a list of records, not a record")
        else:
            p, o = where()
            listed = stack and stack[-1][0] == "]"
            if p in lists and not listed:
                if value is None:
                    out.append((p, o, None))
                    continue
                o = (*o, 0)
            if p in objects and isinstance(value, str) and _looks_like(value):
                inner: list = []
                try:
                    _walk(events(value), p, o, lists, objects, inner, False)
                    out.extend(inner)
                    continue
                except Incomplete:
                    pass
            out.append((p, o, value))


def _plan(tables: tuple[Table, ...]):
    lists, objects = set(), {()}
    for t in tables:
        clean: tuple[str, ...] = ()
        for part in t.path:
            clean = (*clean, part.removesuffix("[]"))
            if part.endswith("[]"):
                lists.add(clean)
            objects.add(clean)
        for path in t.fields.values():
            parts = tuple(path.split("."))
            objects |= {(*clean, *parts[:k]) for k in range(1, len(parts))}
    return frozenset(lists), frozenset(objects)


def rows_of(text: str, tables: tuple[Table, ...], plan=None) -> Iterator[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """(table, ordinals, fields) of one record: its triples grouped by their repeated ancestor."""
    got = triples(text, *(plan or _plan(tables)))
    for t in tables:
        clean = tuple(p.removesuffix("[]") for p in t.path)
        n, depth = len(clean), t.depth
        leaf = {tuple(path.split(".")): c for c, path in t.fields.items()}
        bare = {tuple(inner.split(".")): leaf[tuple(path.split("."))] for inner, path in (t.bare_fields or {}).items()}
        if t.bare:
            bare[()] = t.bare
        groups: dict[tuple[int, ...], dict] = {}
        for path, at, value in got:
            if path[:n] != clean or len(at) < depth:
                continue
            row = groups.setdefault(at[:depth], {})
            if value is None or len(at) > depth:
                continue
            rest = path[n:]
            if column := leaf.get(rest) or (bare.get(rest) if isinstance(value, str) else None):
                row[column] = {True: "true", False: "false"}[value] if isinstance(value, bool) else value
        for at, row in groups.items():
            yield t.name, at, row


GROUPED = "record_id string, table_name string, ordinals array<long>, fields map<string,string>"


def grouped(df: DataFrame, id_col: str, json_col: Column, tables: tuple[Table, ...]) -> DataFrame:
    """record_id, table_name, ordinals, fields: the rows of all the tables, in one narrow pass over the records."""
    plan = _plan(tables)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("record_id", pa.string()), ("table_name", pa.string()), ("ordinals", pa.list_(pa.int64())), ("fields", pa.map_(pa.string(), pa.string()))])

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(rid, name, at, list(row.items())) for name, at, row in rows_of(text, tables, plan)]
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    source = df.select(df[id_col].cast("string").alias("record_id"), json_col.alias("j")).where("j is not null")
    return source.mapInArrow(run, GROUPED)


def pivoted(rows: DataFrame, table: Table) -> DataFrame:
    """record_id, <list>_no for each repeated ancestor, then the table's fields: parent and child share their keys."""
    names = [p.removesuffix("[]") for p in table.path if p.endswith("[]")]
    return rows.where(F.col("table_name") == table.name).select(
        "record_id", *(F.col("ordinals")[k].alias(f"{n}_no") for k, n in enumerate(names)), *(F.col("fields")[c].alias(c) for c in table.fields)
    )


def flatten(df: DataFrame, id_col: str, json_col: Column, tables: tuple[Table, ...]) -> dict[str, DataFrame]:
    """name -> flat table with its parents' keys, for each declared table.

    json_col: JSON text, or ``to_json`` of a typed column. Null, blank, broken or cut-off text, and scalars, give no
    rows; null entries of lists give a row of nulls, so ordinals stay gapless. Values are unaltered text; numbers keep
    their spelling. Very long and very deep records are parsed without recursion; of a key that is repeated in one object
    the last value holds. Repeated records give their rows again. Extra columns are ignored.
    """
    rows = grouped(df, id_col, json_col, tables)
    return {t.name: pivoted(rows, t) for t in tables}


#: The shapes of this corpus.
ITEM_FIELDS = {"time_block": "time_block", "activity": "activity", "mode": "transport.mode", "details": "transport.details", "cost_currency": "cost_estimate.currency", "cost_amount": "cost_estimate.amount", "booking_needed": "booking_needed"}
RESPONSE_DAYS = Table("days", ("payload", "trip_days[]"), {"day": "day", "summary": "summary"})
RESPONSE_ITEMS = Table("itinerary_items", ("payload", "trip_days[]", "items[]"), ITEM_FIELDS | {"place": "location"}, bare_fields={"transport": "transport.mode"})
RESPONSE_GROUPS = Table("groups", ("payload", "groups[]"), {"name": "name"})
RESPONSE_CHECKS = Table("checklist_items", ("payload", "groups[]", "items[]"), {"text": "text", "priority": "priority", "when_due": "when", "done": "done", "notes": "notes"}, bare="text")
RESPONSE_WARNINGS = Table("warnings", ("payload", "trip_days[]", "items[]", "warnings[]"), {"warning": "warning"}, bare="warning")
VALID_DAYS = Table("days", ("trip_days[]",), {"day": "day_no", "summary": "summary"})
VALID_GROUPS = Table("groups", ("check_groups[]",), {"name": "group_name"})
VALID_WARNINGS = Table("warnings", ("trip_days[]", "items[]", "warnings[]"), {"warning": "warning"}, bare="warning")
VALID_ITEMS = Table("itinerary_items", ("trip_days[]", "items[]"), ITEM_FIELDS | {"place": "place"}, bare_fields={"transport": "transport.mode"})
VALID_CHECKS = Table("checklist_items", ("check_groups[]", "items[]"), {"text": "text", "priority": "priority", "when_due": "when_due", "done": "done", "notes": "notes"}, bare="text")
