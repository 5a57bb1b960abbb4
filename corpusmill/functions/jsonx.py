"""JSON text within free text: strict and lenient extraction, contracts, field presence.

The exact rules (duplicate keys, NaN, first bracket that closes) are those of a JSON parser, so they run in Python over
Arrow batches, one pass for all results; everything after is columns.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed, schema

_FENCES = (re.compile(r"```(?:json)?\s*\n(.*?)\n```", re.S), re.compile(r"```(.*?)```", re.S))


class MISSING:
    """Stands for no value (null is one). A class, as it stays the same one when functions are sent to workers."""



def strict(text: str | None):
    """The value of a text that is JSON and nothing else; MISSING if it is not."""
    try:
        return json.loads(text) if text is not None else MISSING
    except (ValueError, RecursionError):
        return MISSING


def balanced(text: str, opening: str, heed_strings: bool = False) -> str | None:
    """From the first opening bracket to the one that closes it; None if it is never closed."""
    at = text.find(opening)
    if at < 0:
        return None
    closing = "}" if opening == "{" else "]"
    marks = re.compile(r'"(?:[^"\\]|\\.)*"|[' + re.escape(opening + closing) + "]", re.S) if heed_strings else re.compile("[" + re.escape(opening + closing) + "]")
    depth = 0
    for m in marks.finditer(text, at):
        depth += {opening: 1, closing: -1}.get(m[0], 0)
        if depth == 0:
            return text[at : m.end()]
    return None


def lenient(text: str | None, heed_strings: bool = False, longest: int = fixed.MAX_CANDIDATE):
    """The first object in a code fence, else what the fences hold first, else the object (then the array) from the first
    bracket; MISSING if nothing parses."""
    if text is None:
        return MISSING
    held = [m[1].strip() for f in _FENCES for m in f.finditer(text)]
    rest = (b for o in "{[" if (b := balanced(text, o, heed_strings)) is not None)
    for pieces in (held, rest):
        values = [v for p in pieces if len(p) <= longest and (v := strict(p)) is not MISSING]
        if values:
            return next((v for v in values if isinstance(v, dict)), values[0])
    return MISSING


def greedy(text: str | None):
    """The object in the first fence, else everything from the first to the last brace; MISSING if it doesn't parse."""
    if text is None:
        return MISSING
    for f in _FENCES:
        if (m := f.search(text)) and (v := strict(m[1].strip())) is not MISSING:
            return v
    m = re.search(r"\{.*\}", text, re.S)
    return strict(m[0]) if m else MISSING


def first_object(text: str) -> str:
    """The first complete object by brackets; the text itself if there is none."""
    return balanced(text, "{") or text


def missing_fields(value: object, paths: tuple[str, ...]) -> list[str]:
    """The dotted paths at which there is nothing: absent, null, a blank string, an empty list or object."""
    out = []
    for path in paths:
        at = value
        for step in path.split("."):
            at = at.get(step) if isinstance(at, dict) else None
        if at is None or isinstance(at, str) and not at.strip() or isinstance(at, (list, dict)) and not at:
            out.append(path)
    return out


def contract(value: object) -> tuple[str | None, str | None, str | None]:
    """(error code, path, rule) of a parsed answer; all None if envelope and payload are as they should be."""
    p = schema.problem(schema.ENVELOPE, value)
    if p:
        return ("ENVELOPE_SCHEMA_FAILED", *p)
    p = schema.problem(schema.PAYLOADS[value["payload_type"]], value["payload"])
    return ("PAYLOAD_SCHEMA_FAILED", *p) if p else (None, None, None)


RESULT = "strict_json_ok boolean, lenient_json_ok boolean, is_object boolean, strict_code string, lenient_code string, failed_at string, rule string, payload_type string, missing array<string>, found string"


def parsed(df: DataFrame, text: str, keep: list[str], required: tuple[str, ...] = fixed.ENVELOPE_KEYS, normalizer=None) -> DataFrame:
    """The kept columns and RESULT of each row's text: whether it parses strictly and leniently, the error codes of both
    ways (null: none), where the contract fails, the missing required fields and the found JSON with sorted keys.

    normalizer: a function applied to the parsed value before its contract. Null texts parse in no way."""
    types = [df.schema[k] for k in keep]

    def run(batches):
        import pyarrow as pa

        names = [r.split()[0] for r in RESULT.split(", ")]
        kinds = [pa.bool_(), pa.bool_(), pa.bool_(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)).to_pylist():
                a = strict(t)
                b = a if a is not MISSING else lenient(t)
                if b is not MISSING and normalizer is not None:
                    b = normalizer(b)
                code = (None, None, None) if b is MISSING else contract(b)
                soft = "JSON_LENIENT_PARSE_FAILED" if b is MISSING else code[0]
                hard = "JSON_STRICT_PARSE_FAILED" if a is MISSING else code[0]
                whole = isinstance(b, dict)
                kind = b.get("payload_type") if whole else None
                rows.append((a is not MISSING, b is not MISSING, whole, hard, soft, code[1], code[2], kind if isinstance(kind, str) else None, missing_fields(b, required) if whole else list(required), None if b is MISSING else json.dumps(b, sort_keys=True, ensure_ascii=False, separators=(",", ":"))))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep, *names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    return df.select(*keep, text).mapInArrow(run, f"{out}, {RESULT}")


def contract_flags(rows: DataFrame) -> DataFrame:
    """strict_json_ok, lenient_json_ok, envelope_ok, payload_ok, overall_ok, error_code of parsed rows: the lenient way
    counts where the strict one can't parse."""
    code = F.when(F.col("strict_json_ok"), F.col("strict_code")).otherwise(F.col("lenient_code"))
    envelope = F.col("lenient_json_ok") & (code.isNull() | (code == "PAYLOAD_SCHEMA_FAILED"))
    payload = F.col("lenient_json_ok") & code.isNull()
    return rows.withColumns({"envelope_ok": envelope, "payload_ok": payload, "overall_ok": payload, "error_code": code})


def local_contract(rows: DataFrame) -> DataFrame:
    """error_type, envelope_ok, payload_ok by the strict result first."""
    code = F.coalesce("strict_code", F.when(~F.col("strict_json_ok"), F.col("lenient_code")))
    return rows.withColumns({"error_type": code, "envelope_ok": code.isNull() | (code == "PAYLOAD_SCHEMA_FAILED"), "payload_ok": code.isNull()})


def gated_contract(rows: DataFrame, mode: str = "lenient") -> DataFrame:
    """overall_ok by one way of parsing only: "strict" or "lenient"."""
    code = F.col("strict_code" if mode == "strict" else "lenient_code")
    return rows.withColumns({"gating_mode": F.lit(mode), "error_code": code, "overall_ok": code.isNull()})


def is_strict(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else, as a column (no duplicate keys, no NaN).

    A parser that stops after the first value would accept text after it; wrapped in a list with a mark behind it, such
    text breaks the list."""
    mark = F.sha2(c, 256)
    whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce((F.size(F.try_variant_get(whole, "$", "array<variant>")) == 2) & (F.try_variant_get(whole, "$[1]", "string") == mark), F.lit(False))


def preview(c: Column) -> Column:
    """The keys of an object, or the length of an array."""
    return F.coalesce(F.array_join(F.json_object_keys(c), ","), F.json_array_length(c).cast("string"))


def sorted_json(c: Column) -> Column:
    """JSON text with sorted keys and no white space."""
    return F.to_json(F.try_parse_json(c))
