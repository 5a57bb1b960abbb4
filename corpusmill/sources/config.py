"""Small inputs of a run, read on the driver: configurations, templates, registries, folders that must be complete."""

from __future__ import annotations

import json
import os
from functools import lru_cache


def load(path: str, required: tuple[str, ...] = ()) -> dict:
    """A JSON or YAML mapping; keys that are required and lacking are an error. YAML needs the yaml package."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise RuntimeError("YAML needs the yaml package; JSON works without") from None
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    lacking = [k for k in required if k not in value]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return value


#: Keys of a generator's specification.
SPEC_KEYS = ("version", "seed", "total_examples", "payload_type_distribution", "category_distribution", "difficulty_levels", "region_tags", "locations", "user_profiles")


def spec(path: str) -> dict:
    """A specification in the generator's own names (plan.prompt_plan)."""
    s = load(path, SPEC_KEYS)
    places = {r: [(p["country"], p["cities"]) for p in ps] for r, ps in s["locations"].items()}
    empty = [r for r in s["region_tags"] if not places.get(r)]
    if empty:
        raise ValueError(f"no locations for {', '.join(empty)}")
    limits = s.get("prompt_constraints", {})
    return {
        "seed": s["seed"], "total_examples": s["total_examples"], "payload_types": s["payload_type_distribution"], "categories": s["category_distribution"], "difficulties": s["difficulty_levels"],
        "regions": s["region_tags"], "locations": places, "user_profiles": s["user_profiles"], "constraint_rate": limits.get("constraint_rate", 0.5), "contexts": s.get("contexts", {}), "templates": s.get("templates", {}),
    }


def text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=64)
def json_document(path: str) -> object:
    """A JSON document, read once."""
    return json.loads(text(path))


def complete(folder: str, names: tuple[str, ...]) -> dict[str, str]:
    """name -> path of the files a folder must have."""
    paths = {n: os.path.join(folder, n) for n in names}
    lacking = [n for n, p in paths.items() if not os.path.exists(p)]
    if lacking:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
    return paths


def lookup(registry: dict, name: str) -> dict:
    """An entry of a registry by its name or one of its aliases."""
    for key, entry in registry.items():
        if name == key or name in entry.get("aliases", ()):
            return entry | {"name": key}
    raise KeyError(f"{name} is none of {', '.join(registry)}")


def write_text(path: str, value: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(value)
