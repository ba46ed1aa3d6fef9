"""Default settings of the retrieval plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


# The defaults the documented behaviour depends on.
@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    chunk_types: tuple[str, ...] = ("event",)
    profile_types: tuple[str, ...] = ("character", "terminology", "summary")
    embedding_dim: int = 1024
    passage_prefix: str = ""
    query_prefix: str = ""
    batch_size: int = 32
    max_batch_chars: int = 32_000
    pool: int = 30
    max_series: int = 4
    min_score: float = 0.5
    margin: float = 0.02
    judge_chunks: int = 8
    judge_chunk_chars: int = 8_000
    max_context_chars: int = 60_000
    source_chars: int = 400
    recommend_count: int = 5
    min_plot_fill: float = 0.8
    ready_fill: float = 0.9
    rrf_k: int = 60
    paragraph_target: int = 700
    min_plot_chars: int = 500


DEFAULTS = Settings()


def load_settings(path: str | None = None) -> Settings:
    """Settings with values overridden by a flat or sectioned JSON file; unknown keys are an error."""
    if path is None:
        return DEFAULTS
    import json

    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    flat: dict = {}
    for key, value in raw.items():
        flat.update(value if isinstance(value, dict) else {key: value})
    known = {f.name for f in fields(Settings)}
    unknown = sorted(set(flat) - known)
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return replace(DEFAULTS, **{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()})


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments are skipped and variables already set are left alone."""
    added = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (part.strip() for part in line.split("=", 1))
        if key not in os.environ:
            os.environ[key] = added[key] = value.strip("\"'")
    return added
