"""Settings: defaults, overlaid by a YAML file, a ``.env`` file and environment variables ``QUARRY_SECTION__KEY``, in that order."""

from __future__ import annotations

import dataclasses
import os
import typing
from dataclasses import dataclass, field
from pathlib import Path

PREFIX = "QUARRY_"


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 600
    max_tokens: int = 800
    overlap_tokens: int = 60
    table_max_tokens: int = 1500


@dataclass(frozen=True)
class Retrieval:
    prefetch_k: int = 40
    top_k: int = 8
    max_per_doc: int = 3
    max_context_tokens: int = 8000


@dataclass(frozen=True)
class Embedding:
    model: str = "hash-32"
    dims: int = 32
    batch_size: int = 256
    concurrency: int = 4
    usd_per_million_tokens: float = 0.13


@dataclass(frozen=True)
class Evaluation:
    k: int = 8
    threshold: float = 0.05
    questions_per_chunk: int = 2
    max_chunks: int = 60


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    embedding: Embedding = field(default_factory=Embedding)
    evaluation: Evaluation = field(default_factory=Evaluation)
    pipeline_version: int = 1
    store: str = "quarry-store"


def _cast(kind: type, value: object) -> object:
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return kind(value)


def _overlay(section, values: dict):
    """A copy of a settings object with those of ``values`` that it has."""
    kinds = typing.get_type_hints(type(section))
    changes = {}
    for name, value in values.items():
        if name in kinds:
            old = getattr(section, name)
            changes[name] = _overlay(old, value) if dataclasses.is_dataclass(old) else _cast(kinds[name], value)
    return dataclasses.replace(section, **changes)


def _nested(flat: dict[str, str]) -> dict:
    out: dict = {}
    for name, value in flat.items():
        if name.upper().startswith(PREFIX):
            *sections, last = name[len(PREFIX) :].lower().split("__")
            node = out
            for s in sections:
                node = node.setdefault(s, {})
            node[last] = value
    return out


def load(yaml_path: str | Path | None = None, env_path: str | Path | None = None, environ: dict[str, str] | None = None) -> Settings:
    found = Settings()
    if yaml_path and Path(yaml_path).exists():
        import yaml

        found = _overlay(found, yaml.safe_load(Path(yaml_path).read_text(encoding="utf-8")) or {})
    if env_path and Path(env_path).exists():
        lines = (x.strip() for x in Path(env_path).read_text(encoding="utf-8").splitlines())
        pairs = (x.removeprefix("export ").split("=", 1) for x in lines if x and x[0] != "#" and "=" in x)
        found = _overlay(found, _nested({k.strip(): v.strip().strip("\"'") for k, v in pairs}))
    return _overlay(found, _nested(dict(os.environ if environ is None else environ)))
