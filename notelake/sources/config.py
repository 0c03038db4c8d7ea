"""Engine settings from YAML, with defaults for everything and ``${VAR}`` taken from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import yaml

from ..functions.tokens import TokenCounter
from . import providers


def resolve_env(value: Any) -> Any:
    """``${NAME}`` in any string below ``value`` replaced; unset names become empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{([^}]+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: resolve_env(v) for k, v in value.items()}
    return [resolve_env(v) for v in value] if isinstance(value, list) else value


@dataclass
class Model:
    model: str = ""
    max_tokens: int = 1000
    temperature: float = 0.0


@dataclass
class Models:
    """A chat service and a model for each role; without a ``base_url`` there is none."""

    provider: str = "offline"
    base_url: str = ""
    api_key: str = ""
    router: Model = field(default_factory=lambda: Model(max_tokens=500))
    extractor: Model = field(default_factory=lambda: Model(max_tokens=2000))
    synthesizer: Model = field(default_factory=lambda: Model(temperature=0.1))


@dataclass
class Embeddings:
    """An embedding service; without a ``base_url`` the offline one."""

    provider: str = "offline"
    base_url: str = ""
    model: str = ""
    dimensions: int = 1536
    batch_size: int = 64


@dataclass
class Folder:
    path: str = "vault"
    index_on_startup: bool = True
    watch: bool = True
    debounce_seconds: float = 3.0


@dataclass
class Index:
    """``tokenizer`` is a file of ranks that counts tokens; without one they are estimated."""

    db_path: str = "index"
    fact_extraction: bool = True
    chunk_max_tokens: int = 1500
    tokenizer: str = ""


@dataclass
class Undo:
    max_operations: int = 50


@dataclass
class Settings:
    vault: Folder = field(default_factory=Folder)
    models: Models = field(default_factory=Models)
    embeddings: Embeddings = field(default_factory=Embeddings)
    index: Index = field(default_factory=Index)
    undo: Undo = field(default_factory=Undo)

    def chat(self) -> providers.Chat | None:
        m = self.models
        roles = {r: asdict(getattr(m, r)) for r in ("router", "extractor", "synthesizer")}
        return providers.HttpChat(m.base_url, m.api_key, roles) if m.base_url else None

    def counter(self) -> TokenCounter | None:
        return TokenCounter.read(self.index.tokenizer) if self.index.tokenizer else None

    def embedder(self) -> providers.Embedder:
        e = self.embeddings
        if e.base_url:
            return providers.HttpEmbedder(e.base_url, e.model, self.models.api_key, e.dimensions, e.batch_size)
        return providers.OfflineEmbedder(batch_size=e.batch_size)


def _fill(target: Any, given: dict) -> Any:
    """``target`` with the values that are given, as their defaults' types; nulls and sections that are no mappings keep the defaults."""
    for f in fields(target):
        value, now = given.get(f.name), getattr(target, f.name)
        if is_dataclass(now):
            _fill(now, value if isinstance(value, dict) else {})
        elif value is not None:
            setattr(target, f.name, value if isinstance(now, bool) else type(now)(value))
    return target


def load(path: str | Path | None = None) -> Settings:
    """Settings of a YAML file; a missing file or section keeps the defaults, other sections are ignored."""
    if path is None or not Path(path).exists():
        return Settings()
    return _fill(Settings(), resolve_env(yaml.safe_load(Path(path).read_text("utf-8")) or {}))
