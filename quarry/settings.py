"""Settings: defaults, TOML files, environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from quarry.functions.classify import CONFIG, DATA, DOCS, MARKERS

PREFIX = "QUARRY_"
SECRET = ("embed_api_key",)
CHOICES = {"ranker": ("rrf", "none"), "coverage": ("hybrid", "definition"), "lexical_mode": ("full", "capped"), "split_identifiers": ("off", "inline", "append"), "refresh_mode": ("auto", "manual"), "embed_backend": ("static", "http", "none")}


class ConfigError(ValueError):
    pass


def _list(*items: str):
    return field(default=items)


@dataclass(frozen=True)
class Settings:
    ranker: str = "rrf"
    prose_min_words: int = 4
    adaptive_alpha: bool = True
    alpha_symbol: float = 0.3
    alpha_prose: float = 0.5
    saturation_decay: float = 0.5
    rerank: bool = True
    file_coherence: float = 0.2
    stem_boost: float = 1.0
    definition_boost: float = 3.0
    candidate_depth: int = 30
    distill_docs: bool = False
    content: tuple[str, ...] = _list()
    content_excluded: tuple[str, ...] = _list("data")
    index_excluded: tuple[str, ...] = _list("data")
    doc_languages: tuple[str, ...] = _list(*DOCS)
    config_languages: tuple[str, ...] = _list(*CONFIG)
    data_languages: tuple[str, ...] = _list(*DATA)
    test_markers: tuple[str, ...] = _list(*MARKERS)
    embed_backend: str = "static"
    embed_model: str = "hashed-64"
    embed_endpoint: str = ""
    embed_api_key: str = ""
    embed_query_prefix: str | None = None
    embed_doc_prefix: str | None = None
    coverage: str = "hybrid"
    window_chars: int = 750
    lexical_mode: str = "full"
    lexical_cap_chars: int = 2000
    lexical_enrich: bool = False
    split_identifiers: str = "off"
    max_chunk_lines: int = 200
    data_dir: str | None = None
    gitignore: bool = True
    hard_exclude: tuple[str, ...] = _list(".git", ".quarry", ".venv", "venv", "node_modules", "__pycache__", ".build", "dist", "target", ".pytest_cache", ".mypy_cache")
    max_file_bytes: int = 1_000_000
    refresh_mode: str = "auto"
    rescan_after_seconds: int = 5


def _flat(table: dict) -> dict:
    out: dict = {}
    for k, v in table.items():
        out |= _flat(v) if isinstance(v, dict) else {k: v}
    return out


def _kind(name: str) -> str:
    return str(next(f.type for f in fields(Settings) if f.name == name))


def _checked(name: str, value):
    kind = _kind(name)
    ok = {"int": isinstance(value, int) and not isinstance(value, bool), "float": isinstance(value, int | float) and not isinstance(value, bool), "bool": isinstance(value, bool)}
    if "tuple" in kind:
        if not isinstance(value, list | tuple) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"setting {name} expects a list of strings")
        return tuple(value)
    if not ok.get(kind, isinstance(value, str)):
        raise ConfigError(f"setting {name} expects {kind}")
    if name in CHOICES and value not in CHOICES[name]:
        raise ConfigError(f"unknown {name} {value!r}; expected {', '.join(map(repr, CHOICES[name]))}")
    return float(value) if kind == "float" else value


def _parsed(name: str, raw: str):
    kind = _kind(name)
    try:
        if kind == "bool":
            return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False, "": False}[raw.strip().lower()]
        if kind in ("int", "float"):
            return (int if kind == "int" else float)(raw.strip())
    except (KeyError, ValueError):
        raise ConfigError(f"{PREFIX}{name.upper()} expects {kind}; got {raw!r}") from None
    return [x.strip() for x in raw.split(",") if x.strip()] if "tuple" in kind else raw


def load(user: Path | None = None, repo: Path | None = None, env: dict[str, str] | None = None) -> Settings:
    """Defaults under the user's file, the tree's file and the environment; unknown keys are errors.

    Tables and flat keys mean the same.  A secret is refused in the tree's file.
    """
    env = dict(os.environ) if env is None else env
    read = lambda p: _flat(tomllib.loads(p.read_text())) if p and p.is_file() else {}
    own = read(repo)
    if leaked := [s for s in SECRET if s in own]:
        raise ConfigError(f"{', '.join(leaked)} must not be set in {repo}, which is meant to be committed")
    merged = read(user) | own
    names = [f.name for f in fields(Settings)]
    if unknown := sorted(set(merged) - set(names)):
        raise ConfigError(f"unknown setting(s): {', '.join(unknown)}")
    merged |= {n: _parsed(n, env[PREFIX + n.upper()]) for n in names if PREFIX + n.upper() in env}
    return replace(Settings(), **{n: _checked(n, v) for n, v in merged.items()})


def as_toml(s: Settings) -> str:
    def show(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, tuple):
            return "[" + ", ".join(f'"{x}"' for x in v) + "]"
        return f'"{v}"' if isinstance(v, str) else str(v)

    return "".join(f"{f.name} = {show(getattr(s, f.name))}\n" for f in fields(s) if getattr(s, f.name) is not None and f.name not in SECRET)
