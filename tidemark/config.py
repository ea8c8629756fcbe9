"""Engine settings: ten knobs with their defaults, checked when they are set."""

from __future__ import annotations

import os
from dataclasses import dataclass

FSYNC_POLICIES = ("EVERY_WRITE", "BATCH", "NONE")


@dataclass(frozen=True)
class EngineConfig:
    """Immutable settings. ``wal_dir`` follows ``data_dir`` unless it is given.

    ``fsync_policy`` says when a put is durable: at once (EVERY_WRITE), with every ``batch_fsync_size``-th
    put (BATCH), or not before ``sync``, ``flush`` or ``close`` (NONE).
    """

    data_dir: str = "data"
    wal_dir: str | None = None
    memtable_max_size_bytes: int = 4 * 1024 * 1024
    fsync_policy: str = "EVERY_WRITE"
    batch_fsync_size: int = 64
    bloom_expected_insertions: int = 10_000
    bloom_fpp: float = 0.01
    sparse_index_interval: int = 128
    compaction_min_tables: int = 4
    compaction_size_ratio: float = 1.5

    def __post_init__(self) -> None:
        if self.wal_dir is None:
            object.__setattr__(self, "wal_dir", os.path.join(self.data_dir, "wal"))
        if self.fsync_policy not in FSYNC_POLICIES:
            raise ValueError(f"fsync_policy must be one of {FSYNC_POLICIES}")
        for name in ("memtable_max_size_bytes", "batch_fsync_size", "bloom_expected_insertions", "sparse_index_interval"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.bloom_fpp < 1:
            raise ValueError("bloom_fpp must lie between 0 and 1")
        if self.compaction_min_tables < 2:
            raise ValueError("compaction_min_tables must be 2 at least")
        if self.compaction_size_ratio < 1:
            raise ValueError("compaction_size_ratio must be 1 at least")

    @property
    def segments_dir(self) -> str:
        return os.path.join(self.data_dir, "segments")

    @property
    def manifest_dir(self) -> str:
        return os.path.join(self.data_dir, "manifest")
