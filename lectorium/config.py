"""Settings: defaults, then a file's values, then the environment; values that can't be read keep the default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

PREFIX = "LECTORIUM_"
SECRET = ("api_key", "token")


@dataclass(frozen=True)
class Config:
    library_path: str = ""
    embedding_url: str = "http://localhost:11434"
    embedding_model: str = "hashing"
    embedding_batch_size: int = 64
    embedding_workers: int = 2
    embedding_dimension: int = 64
    extract_workers: str = "auto"
    extract_auto_max_workers: int = 8
    llm_provider: str = ""
    llm_model: str = ""
    llm_api_key: str = ""
    chunk_size: int = 500
    chunk_overlap: int = 100
    search_limit: int = 10
    prompt_budget: int = 3000
    prompt_chunk_limit: int = 500
    timeout_ingest_s: int = 1800
    timeout_search_s: int = 30
    timeout_ask_s: int = 60
    timeout_reindex_s: int = 1800
    timeout_probe_s: int = 120
    timeout_batch_s: int = 300
    timeout_chunk_s: int = 180

    @classmethod
    def load(cls, values: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
        """Defaults overridden by `values` (a parsed file) and by LECTORIUM_* of `env` (the process's by default)."""
        env = os.environ if env is None else env
        merged: dict[str, Any] = {}
        for f in fields(cls):
            for given in ((values or {}).get(f.name), env.get(PREFIX + f.name.upper())):
                if given in (None, ""):
                    continue
                try:
                    value = int(given) if isinstance(f.default, int) else str(given)
                except (TypeError, ValueError):
                    continue
                if isinstance(value, int) and value < 0:
                    continue
                if f.name == "extract_workers" and value != "auto" and not (value.isdigit() and int(value) > 0):
                    continue
                merged[f.name] = value
        return cls(**merged)

    @classmethod
    def from_json(cls, path: str, env: Mapping[str, str] | None = None) -> Config:
        """As load, from a JSON file; a missing or broken file counts as empty."""
        try:
            with open(path, encoding="utf-8") as f:
                values = json.load(f)
        except (OSError, ValueError):
            values = {}
        return cls.load(values if isinstance(values, dict) else {}, env)

    def show(self) -> dict[str, Any]:
        """All settings, with secrets hidden."""
        return {f.name: "***" if f.name.endswith(SECRET) and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}
