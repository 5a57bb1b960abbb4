"""Export of records as chat rows for fine-tuning: completed envelopes, canonical targets, messages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed, jsonx

SYSTEM = "You answer travel questions with one JSON object and nothing else."
DEFAULTS = {"summary": "See payload.", "uncertainty_notes": "Verify details with official sources.", "verification_steps": ["Check official sources for current information."]}
TITLES = {"decision_tree": ("Decision Tree", "nodes"), "checklist": ("Checklist", "groups")}


def tidy_payload(payload: dict, kind: str) -> dict:
    """Items of itineraries have a time_block and no time_buffer; trees and checklists have their title and list."""
    payload = dict(payload)
    if kind in TITLES:
        title, rows = TITLES[kind]
        payload["title"] = payload.get("title") or title
        if not isinstance(payload.get(rows), list):
            payload[rows] = []
    elif kind == "itinerary" and isinstance(payload.get("trip_days"), list):

        def item(x):
            if not isinstance(x, dict):
                return x
            rest = {k: v for k, v in x.items() if k != "time_buffer"}
            return rest if "time_block" in rest else rest | {"time_block": x.get("time_buffer", "See summary")}

        def day(x):
            return x | {"items": [item(i) for i in x["items"]]} if isinstance(x, dict) and isinstance(x.get("items"), list) else x

        payload["trip_days"] = [day(x) for x in payload["trip_days"]]
    return payload


def complete(response: object, payload_type: str | None) -> dict:
    """The answer with all keys of the envelope; what is missing or of another type gets a default."""
    out = dict(response) if isinstance(response, dict) else {"summary": str(response)}
    for key in ("summary", "uncertainty_notes"):
        out[key] = out.get(key) or DEFAULTS[key]
    for key in ("assumptions", "next_steps", "verification_steps"):
        if not isinstance(out.get(key), list):
            out[key] = list(DEFAULTS.get(key, []))
    kind = out.get("payload_type") or payload_type
    out["payload_type"] = kind if kind in fixed.PAYLOAD_TYPES else "checklist"
    out["payload"] = tidy_payload(out["payload"] if isinstance(out.get("payload"), dict) else {}, out["payload_type"])
    return out


def normalize_envelope(value: object) -> object:
    """A teacher's answer in the envelope's types: a list around it is taken off, strings become lists of steps, aliases of
    payload types their names, other payloads objects."""
    if isinstance(value, list) and len(value) == 1 and isinstance(value[0], dict):
        value = value[0]
    if not isinstance(value, dict):
        return value
    out = dict(value)
    for key in ("assumptions", "next_steps", "verification_steps"):
        steps = out.get(key)
        if steps is None or isinstance(steps, (str, list)):
            steps = [steps] if isinstance(steps, str) else steps or []
            out[key] = [s for s in (str(x).strip() for x in steps) if s]
    kind = out.get("payload_type")
    if isinstance(kind, str):
        kind = fixed.PAYLOAD_ALIASES.get(kind.strip().lower(), kind.strip().lower())
        out["payload_type"] = kind if kind in fixed.PAYLOAD_TYPES else "checklist"
    payload = out.get("payload")
    if payload is not None and not isinstance(payload, dict):
        out["payload"] = {"items" if isinstance(payload, list) else "value": payload}
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys, compact, Unicode kept."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def targets(records: DataFrame, response: str = "response", validate: bool = True) -> DataFrame:
    """The records with target (the completed answer as canonical JSON) and sft_error (where the contract fails; null if it
    holds or validate is off). A null or broken response is completed from its text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    at, kind_at = records.columns.index(response), records.columns.index("payload_type")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, errors = [], []
            for text, kind in zip(batch.column(at).to_pylist(), batch.column(kind_at).to_pylist()):
                value = jsonx.strict(text)
                whole = complete({} if text is None else text if value is jsonx.MISSING else value, kind)
                out.append(canonical(whole))
                code, path, rule = jsonx.contract(whole) if validate else (None, None, None)
                errors.append(f"{code} at {path}: {rule}" if code else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "target", "sft_error"])

    return records.mapInArrow(run, schema + ", target string, sft_error string")


def chat_rows(records: DataFrame, split: str, validate: bool = True, system: str = SYSTEM) -> DataFrame:
    """id, messages, target, metadata of the records whose answer keeps its contract."""
    got = targets(records, validate=validate).where("sft_error is null")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    meta = F.struct("payload_type", "category", "difficulty", F.coalesce("region_tags", F.array().cast("array<string>")).alias("region_tags"), F.lit(split).alias("source_split"))
    return got.select("id", F.array(message("system", F.lit(system)), message("user", F.coalesce("prompt", F.lit("")))).alias("messages"), "target", meta.alias("metadata"))


def fixed_prompts(records: DataFrame) -> DataFrame:
    """The six columns of a prompt suite."""
    return records.select("id", "prompt", "payload_type", "category", "difficulty", "region_tags")


def traced(records: DataFrame) -> DataFrame:
    """source and source_id, set only where absent."""
    for c in ("source", "source_id"):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string"))
    return records.withColumn("source", F.coalesce("source", F.lit("v1"))).withColumn("source_id", F.coalesce("source_id", "id", F.lit("unknown")))
