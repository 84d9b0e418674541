"""Settings from KEY=VALUE files and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: Item, collection and score of recordings that no collection holds.
NONE_ID = 4294967295
SINGLE, MULTIPLE, SYMBOLS = -1, -2, -3


def read_env_file(path: str) -> dict[str, str]:
    """``KEY=VALUE`` lines; blank lines and ``#`` comments are skipped, blanks and surrounding quotes stripped; the real environment wins."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        key, eq, value = line.strip().partition("=")
        if not eq or key.lstrip().startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key.strip()] = os.environ.get(key.strip(), value)
    return out


@dataclass(frozen=True)
class Settings:
    index_dir: str = "index"
    source_url: str = ""
    threshold: float = 0.7
    explore_threshold: float = 0.5
    min_credit: int = 1
    min_pending_credit: int = 2
    clean_names: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load(path: str | None = None) -> Settings:
        found = (read_env_file(path) if path else {}) | {k: v for k, v in os.environ.items() if k in ("INDEX_DIR", "SOURCE_URL")}
        return Settings(index_dir=found.get("INDEX_DIR", "index"), source_url=found.get("SOURCE_URL", ""), extra=found)
