"""Settings: a file of JSON, YAML or TOML over a profile over the defaults; unknown keys and values out of range are errors."""

from __future__ import annotations

import copy
import json
import os

# Limits by default, and where the profiles differ from them: fixed values.
DEFAULTS: dict = {
    "profile": "",
    "exclude": [],
    "baseline": "",
    "waivers": [],
    "rule_packs": [],
    "format": "text",
    "sections": ["quality", "design", "security", "prompts", "ci"],
    "quality": {"max_file_lines": 400, "max_function_lines": 80, "max_parameters": 5, "max_complexity": 10, "clone_tokens": 90},
    "design": {"max_decls_per_file": 12, "max_methods_per_type": 8, "max_interface_methods": 5, "god_module": 25, "high_impact": 10, "min_fan_in": 3, "max_instability_delta": 0.35, "layers": []},
    "performance": {"hot_importers": 8, "rebuild_dependents": 20, "benchmark_percent": 20, "build_percent": 20},
    "change": {"max_files": 25, "max_directories": 8, "max_lines": 800, "max_public_interfaces": 3, "max_concerns": 3, "min_test_percent": 20},
    "context": {"max_file_lines": 1500, "ambiguous_threshold": 4, "agent_doc_lines": 600},
    "secrets": {"enabled": True, "allow_paths": [], "allow_patterns": [], "custom_patterns": [], "entropy": False, "min_length": 20, "min_entropy": 4.5},
    "commands": {"trusted": False, "checks": []},
}
PROFILES: dict = {
    "": {},
    "startup": {"quality": {"max_file_lines": 600, "max_function_lines": 120, "max_parameters": 7, "max_complexity": 15, "clone_tokens": 120}},
    "strict": {"quality": {"max_file_lines": 300, "max_function_lines": 60, "max_parameters": 4, "max_complexity": 8, "clone_tokens": 60}},
    "enterprise": {"sections": ["quality", "design", "security", "prompts", "ci", "supply_chain", "contracts"], "secrets": {"entropy": True}},
    "ai-safe": {"sections": ["quality", "design", "security", "prompts", "ci", "supply_chain"], "quality": {"max_function_lines": 60, "max_complexity": 8}},
}
SECTIONS = ("quality", "design", "security", "prompts", "ci", "supply_chain", "contracts", "context", "performance", "change", "data", "reliability", "delivery", "error", "function", "naming", "observability", "operations", "defensive", "smell", "testing", "maintainability", "custom")


def _over(base: dict, other: dict, where: str, wrong: list[str]) -> dict:
    out = copy.deepcopy(base)
    for key, value in other.items():
        if key not in base:
            wrong.append(f"unknown key {where}{key}")
        elif isinstance(base[key], dict):
            if isinstance(value, dict):
                out[key] = _over(base[key], value, f"{where}{key}.", wrong)
            else:
                wrong.append(f"{where}{key} is no table")
        elif value is not None:  # null keeps the default
            same = isinstance(value, int | float) and not isinstance(value, bool) if isinstance(base[key], int | float) and not isinstance(base[key], bool) else isinstance(value, type(base[key]))
            if not same:
                wrong.append(f"{where}{key}: {value!r} is of another kind than {base[key]!r}")
            elif isinstance(value, int | float) and not isinstance(value, bool) and value < 0:
                wrong.append(f"{where}{key} is below 0")
            else:
                out[key] = value
    return out


def build(given: dict | None = None, profile: str | None = None) -> dict:
    """The settings; raises ValueError that names every fault."""
    given = given or {}
    name = profile if profile is not None else given.get("profile", "")
    wrong: list[str] = []
    if name not in PROFILES:
        wrong.append(f"unknown profile {name!r}")
    held = _over(_over(DEFAULTS, PROFILES.get(name, {}), "", wrong), given, "", wrong)
    held["profile"] = name
    wrong += [f"unknown section {s!r}" for s in held["sections"] if s not in SECTIONS]
    if held["commands"]["checks"] and not held["commands"]["trusted"]:
        wrong.append("commands.checks need commands.trusted")
    if wrong:
        raise ValueError("; ".join(wrong))
    return held


def load(path: str, profile: str | None = None) -> dict:
    """Settings from a file; rule packs and the baseline must lie beside it or below."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".toml"):
        import tomllib

        given = tomllib.loads(text)
    elif path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ModuleNotFoundError as gone:
            raise ValueError("YAML settings need the yaml package; JSON and TOML do not") from gone
        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    held = build(given, profile)
    root = os.path.realpath(os.path.dirname(path) or ".")
    for name in (*held["rule_packs"], *([held["baseline"]] if held["baseline"] else [])):
        at = os.path.realpath(os.path.join(root, name))
        if os.path.commonpath([at, root]) != root:
            raise ValueError(f"{name} is outside {root}")
    held["rule_packs"] = [os.path.join(root, p) for p in held["rule_packs"]]
    held["baseline"] = os.path.join(root, held["baseline"]) if held["baseline"] else ""
    return held
