"""Settings: defaults, then a file of KEY=value lines, then the environment; checked as a whole, immutable."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "QUILLON_"


@dataclass(frozen=True)
class Settings:
    # The defaults that change results.
    data_dir: str = "data"
    chunk_size: int = 1400
    chunk_overlap: int = 200
    min_chunk: int = 40
    region_merge_gap: float = 14.0
    min_region_area_ratio: float = 0.012
    max_region_area_ratio: float = 0.95
    retrieval_k: int = 6
    rerank_fetch_multiplier: int = 4
    lexical_weight: float = 0.35
    max_context_chars: int = 6000
    max_images_per_answer: int = 2
    max_upload_mb: int = 50
    summarize_text_chunks: bool = False
    summarize_concurrency: int = 4
    llm_max_retries: int = 4
    llm_max_backoff: float = 75.0
    llm_min_interval: float = 0.0
    extractor_backend: str = "pdf"
    ocr_enabled: bool = False
    render_dpi: int = 200
    image_max_dimension: int = 900
    embedding_provider: str = "sha256"
    embedding_model: str = "32"
    embedding_batch: int = 128
    log_level: str = "INFO"
    cors_origins: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be under chunk_size")
        if not 0 <= self.min_region_area_ratio < self.max_region_area_ratio <= 1:
            raise ValueError("min_region_area_ratio must be under max_region_area_ratio")
        if not 1 <= self.retrieval_k <= 25:
            raise ValueError("retrieval_k must be within 1 and 25")
        if min(self.summarize_concurrency, self.embedding_batch, self.max_upload_mb, self.max_context_chars) < 1 or self.llm_max_retries < 0:
            raise ValueError("counts and sizes must be at least 1, retries at least 0")
        if not 0 <= self.lexical_weight <= 1:
            raise ValueError("lexical_weight must be within 0 and 1")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, file: str | None = None, root: str = ".") -> Settings:
        """Names are matched in either case; blank values count as unset; a relative data_dir is anchored at root."""
        given: dict[str, str] = {}
        if file and os.path.exists(file):
            for line in Path(file).read_text().splitlines():
                key, mark, value = line.strip().partition("=")
                if mark and not key.startswith("#"):
                    given[key.strip().upper()] = value.strip().strip("\"'")
        given |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
        kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("1", "true", "yes", "on"), "tuple[str, ...]": lambda v: tuple(x.strip() for x in v.split(",") if x.strip())}
        found = {f.name: kinds[f.type](v) for f in fields(cls) if (v := given.get((PREFIX + f.name).upper(), "").strip())}
        where = found.get("data_dir", cls.data_dir)
        if "://" not in where:
            found["data_dir"] = str(Path(root, where).resolve())
        return cls(**found)
