"""Reports: Markdown and JSON from small aggregates, run folders and manifests. All on the driver; the tables given are
aggregates of bounded size."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame


def percent(v: float | None, digits: int = 1) -> str:
    return "—" if v is None else f"{100 * v:.{digits}f} %"


def seconds(v: float | None) -> str:
    return "—" if v is None else f"{v:.2f} s"


def cell(v: object, longest: int = 80) -> str:
    text = " ".join(str("—" if v is None else v).split()).replace("|", "\\|")
    return text if len(text) <= longest else text[:longest] + "..."


def table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def collected(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of an aggregate; more than expected is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"an aggregate of more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    """A report of tables and texts."""
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else table(collected(body), body.columns)]
    return "\n\n".join(parts) + "\n"


def metrics_report(rollup: DataFrame, curated: DataFrame, taxonomy: DataFrame) -> str:
    """Rates by suite, failure categories and curated failures."""
    shown = []
    for r in sorted(collected(rollup), key=lambda r: (r["is_total"], r["suite"] or "")):
        rates = {k: percent(v) for k, v in r.items() if k.endswith("_rate")}
        shown.append({"suite": "all" if r["is_total"] else r["suite"], "n": r["n"], **rates, "p50": seconds(r["p50_latency_s"]), "p90": seconds(r["p90_latency_s"])})
    columns = list(shown[0]) if shown else ["suite"]
    return "\n\n".join(["# Evaluation", "## Metrics", table(shown, columns), "## Failure categories", table(collected(taxonomy), taxonomy.columns), "## Curated failures", table(collected(curated), curated.columns)]) + "\n"


DEFINITIONS = {
    "strict_json_parse_rate": "share of answers that are JSON and nothing else", "lenient_json_parse_rate": "share of answers that hold JSON", "envelope_pass_rate": "share whose envelope keeps its contract",
    "payload_pass_rate": "share whose payload keeps its contract", "overall_contract_pass_rate": "share in which both do", "required_fields_rate": "share of the answers with required fields that have them all",
    "assumptions_marker_rate": "share that state assumptions", "verification_marker_rate": "share that tell how to verify", "clarifying_questions_rate": "share that ask back", "p50_latency_s": "median latency of positive ones", "p90_latency_s": "90th percentile",
}


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def provenance() -> dict:
    """Commit and whether the tree is dirty; None outside a repository."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}


SECRET = ("key", "token", "secret", "password", "authorization")


def redacted(config: object, deep: bool = True) -> object:
    """A configuration whose secret values are masked."""
    if isinstance(config, dict):
        return {k: "***" if any(s in str(k).lower() for s in SECRET) and v else (redacted(v) if deep else v) for k, v in config.items()}
    return [redacted(v) for v in config] if deep and isinstance(config, list) else config


def flattened(config: dict, prefix: str = "") -> dict:
    """Dotted paths of one level of nesting and their values."""
    out = {}
    for k, v in config.items():
        out |= {f"{k}.{i}": x for i, x in v.items()} if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def changed(a: dict, b: dict, allowed: str) -> list[str]:
    """The dotted paths, but for the allowed one, at which two configurations differ."""
    x, y = flattened(a), flattened(b)
    return sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k) and k != allowed and not k.startswith(allowed + "."))


def write_json(path: str, value: object) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)


def manifest(path: str, params: dict, inputs: list[str], counts: dict) -> dict:
    """Parameters, hashes of the input files and counts of a run, written as JSON."""
    out = {"run_id": run_id(), "params": redacted(params), "inputs": {p: sha256_of(p) for p in inputs}, "counts": counts, **provenance()}
    write_json(path, out)
    return out
