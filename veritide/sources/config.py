"""Settings from defaults, a file and the environment, in that order; and checks of arguments."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from veritide.sources.files import Filtering

# Severities and depths that arguments may name.
LEVELS = ("strict", "moderate", "loose")
FORMATS = ("json", "markdown", "pdf", "html")


@dataclass(frozen=True)
class Limits:
    """The defaults of audits."""

    max_concurrent: int = 3
    cache_hours: int = 24
    max_file_size: int = 1024 * 1024
    max_files: int = 0
    context_lines: int = 5
    max_depth: int = 3
    requests_per_minute: int = 10_000
    tokens_per_minute: int = 400_000


@dataclass(frozen=True)
class Settings:
    limits: Limits = field(default_factory=Limits)
    filtering: Filtering = field(default_factory=Filtering)


def read_mapping(path: str) -> dict:
    """A JSON or TOML file; YAML where its library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith(".toml"):
        return tomllib.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def merged(base, changes: Mapping):
    """A settings object with the known keys of a mapping; lists become tuples."""
    known = {f.name for f in fields(base)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in changes.items() if k in known and v is not None}
    return replace(base, **{k: type(getattr(base, k))(v) if isinstance(getattr(base, k), (int, float)) and not isinstance(getattr(base, k), bool) else v for k, v in given.items()})


def load(path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "AUDIT_") -> Settings:
    """Defaults, then the file's ``limits`` and ``filtering``, then variables such as AUDIT_MAX_FILES."""
    found = read_mapping(path) if path else {}
    env = os.environ if environment is None else environment
    from_env = {k: env[prefix + k.upper()] for k in asdict(Limits()) if prefix + k.upper() in env}
    return Settings(merged(merged(Limits(), found.get("limits", {})), from_env), merged(Filtering(), found.get("filtering", {})))


def argument_problems(args: Mapping) -> list[str]:
    """What is wrong with given arguments; nothing if all is well."""
    out = []
    low, high = args.get("min_confidence", 0.0), args.get("max_confidence", 1.0)
    if not 0 <= low <= 1 or not 0 <= high <= 1:
        out.append("confidences must be between 0 and 1")
    if low > high:
        out.append("min_confidence is above max_confidence")
    if args.get("max_files", 0) < 0:
        out.append("max_files is negative")
    if args.get("filter_level", "strict") not in LEVELS:
        out.append("unknown filter_level")
    if args.get("format", "json") not in FORMATS:
        out.append("unknown format")
    for kind in ("extensions", "paths"):
        both = set(args.get(f"include_{kind}") or ()) & set(args.get(f"exclude_{kind}") or ())
        if both:
            out.append(f"{kind} both included and excluded: {', '.join(sorted(both))}")
    return out
