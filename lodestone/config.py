"""Engine settings; each can be set by the environment as LODESTONE_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# File kinds, folders left out, and directory names that tell a category (in this order, the first that is met wins).
TEXT_EXTENSIONS = (".md", ".txt", ".docx", ".pdf", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".html", ".htm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")
EXCLUDED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "truncated-results")
CATEGORIES = (
    ("论文", "paper"), ("papers", "paper"), ("文献", "paper"), ("notes", "note"), ("笔记", "note"), ("code", "code"), ("src", "code"),
    ("docs", "documentation"), ("文档", "documentation"), ("manual", "manual"), ("手册", "manual"), ("tutorial", "tutorial"), ("教程", "tutorial"), ("api", "api"),
)


@dataclass(frozen=True)
class EngineConfig:
    db_path: str = ""
    chunk_size: int = 800
    #: characters of a chunk that the next one repeats; half the chunk size unless it is set
    overlap_chars: int = 400
    section_chars: int = 1200
    min_doc_chars: int = 20
    min_page_chars: int = 50
    max_file_bytes: int = 25 * 1024 * 1024
    ocr_min_chars: int = 500
    dims: int = 1024
    rerank_top: int = 32
    rerank_chars: int = 1024
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    ivf_min_rows: int = 1000
    debounce_seconds: float = 5.0
    snippet_chars: int = 500
    similar_prefix: int = 512
    store_buckets: int = 32
    #: seconds without a use after which models are unloaded; 0 for never
    idle_seconds: float = 300.0

    @classmethod
    def from_env(cls, **given) -> EngineConfig:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f"LODESTONE_{f.name.upper()}")
            if raw is not None and f.name not in given:
                found[f.name] = type(f.default)(raw)
        return cls(**found, **given)
