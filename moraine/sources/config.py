"""Settings with their defaults, read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from moraine.functions.simhash import STOPWORDS


@dataclass(frozen=True)
class Config:
    """Unknown settings are an error; missing ones have their defaults."""

    bucket_tokens: int = 5
    bucket_seconds: float = 10.0
    cms_accuracy: float = 0.01
    cms_certainty: float = 0.01
    bloom_items: int = 10
    bloom_rate: float = 0.01
    run_bloom_rate: float = 0.01
    summary_every: int = 50
    level_threshold: int = 20
    levels: int = 5
    hll_bits: int = 10
    stopwords: tuple[str, ...] = STOPWORDS
    memtable_keys: int = 50
    wal_segment_bytes: int = 20_000
    cache_entries: int = 1000
    single_file_rows: int = 0  # runs of up to so many rows are one file each

    def __post_init__(self):
        for name in ("bucket_tokens", "bloom_items", "summary_every", "levels", "memtable_keys", "wal_segment_bytes", "cache_entries"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.level_threshold < 2:
            raise ValueError("level_threshold must be at least 2")
        if not 4 <= self.hll_bits <= 16:
            raise ValueError("hll_bits must be from 4 to 16")

    @staticmethod
    def load(path: str, default_if_missing: bool = True) -> Config:
        """The settings of a file; the defaults where there is no file."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except FileNotFoundError:
            if default_if_missing:
                return Config()
            raise
        unknown = set(found) - {f.name for f in fields(Config)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Config(**found | ({"stopwords": tuple(found["stopwords"])} if "stopwords" in found else {}))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
