"""Configuration: YAML with defaults, validated with the path of the wrong field; pubspec files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from corvane.functions.text import analyzer_name
from corvane.operators.metrics import SIZE_LIMITS
from corvane.operators.score import AREAS


@dataclass(frozen=True)
class Config:
    root: str = "."
    exclude: tuple[str, ...] = ()
    enabled: frozenset[str] = frozenset(AREAS)
    limits: dict[str, int] = field(default_factory=lambda: dict(SIZE_LIMITS))
    duplicate_similarity: float = 0.9
    duplicate_min_tokens: int = 20
    duplicate_min_lines: int = 10
    strict: bool = False


class ConfigError(ValueError):
    """Names the field that is wrong."""


def _want(value, kind, where: str):
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise ConfigError(f"{where}: expected {kind.__name__ if isinstance(kind, type) else 'a number'}, got {value!r}")
    return value


def parse_config(data: dict | None, base: str = ".") -> Config:
    """input: {root, exclude}, analyzers: {default: all|none, enabled, disabled, options}, strict."""
    data = _want(data or {}, dict, "document")
    known = {"input", "analyzers", "strict"}
    for k in data:
        if k not in known:
            raise ConfigError(f"{k}: unknown field")
    inputs = _want(data.get("input") or {}, dict, "input")
    root = _want(inputs.get("root", "."), str, "input.root")
    exclude = tuple(_want(x, str, f"input.exclude[{k}]") for k, x in enumerate(_want(inputs.get("exclude") or [], list, "input.exclude")))
    analyzers = _want(data.get("analyzers") or {}, dict, "analyzers")
    default = analyzers.get("default", "all")
    if default not in ("all", "none"):
        raise ConfigError(f"analyzers.default: expected all or none, got {default!r}")

    def names(which: str) -> set[str]:
        found = set()
        for k, x in enumerate(_want(analyzers.get(which) or [], list, f"analyzers.{which}")):
            name = analyzer_name(_want(x, str, f"analyzers.{which}[{k}]"))
            if name not in AREAS:
                raise ConfigError(f"analyzers.{which}[{k}]: unknown analyzer {x!r}")
            found.add(name)
        return found

    enabled = ((set(AREAS) if default == "all" else set()) | names("enabled")) - names("disabled")
    options = _want(analyzers.get("options") or {}, dict, "analyzers.options")
    size = _want(options.get("code_size") or {}, dict, "analyzers.options.code_size")
    limits = dict(SIZE_LIMITS)
    for k, v in size.items():
        if k not in limits:
            raise ConfigError(f"analyzers.options.code_size.{k}: unknown field")
        if _want(v, int, f"analyzers.options.code_size.{k}") <= 0:
            raise ConfigError(f"analyzers.options.code_size.{k}: must be above 0")
        limits[k] = v
    dup = _want(options.get("duplicate_code") or {}, dict, "analyzers.options.duplicate_code")
    similarity = float(_want(dup.get("similarity", 0.9), (int, float), "analyzers.options.duplicate_code.similarity"))
    if not 0 < similarity <= 1:
        raise ConfigError("analyzers.options.duplicate_code.similarity: must be above 0 and at most 1")
    strict = _want(data.get("strict", False), bool, "strict")
    return Config(os.path.normpath(os.path.join(base, root)), tuple(dict.fromkeys(exclude)), frozenset(enabled), limits, similarity, int(dup.get("min_tokens", 20)), int(dup.get("min_lines", 10)), strict)


def load_config(folder: str, name: str = ".corvane.yaml") -> Config:
    import yaml

    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return Config(folder)
    with open(path, encoding="utf-8") as f:
        return parse_config(yaml.safe_load(f), folder)


@dataclass(frozen=True)
class Project:
    name: str = "unknown"
    version: str = ""
    kind: str = "unknown"  # dart, flutter
    dependencies: tuple[str, ...] = ()
    dev_dependencies: tuple[str, ...] = ()


def parse_pubspec(text: str) -> Project:
    import yaml

    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError:
        return Project()
    deps, dev = data.get("dependencies") or {}, data.get("dev_dependencies") or {}
    kind = "flutter" if "flutter" in deps or "flutter" in data else "dart"
    return Project(str(data.get("name") or "unknown"), str(data.get("version") or ""), kind, tuple(sorted(map(str, deps))), tuple(sorted(map(str, dev))))


def find_pubspec(folder: str) -> str | None:
    """The nearest pubspec.yaml at or above the folder: a look at each folder on the way up."""
    at = os.path.abspath(folder)
    while True:
        if os.path.exists(p := os.path.join(at, "pubspec.yaml")):
            return p
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def lock_versions(text: str) -> list[tuple[str, str]]:
    import yaml

    data = yaml.safe_load(text) or {}
    return sorted((str(k), str((v or {}).get("version", ""))) for k, v in (data.get("packages") or {}).items())
