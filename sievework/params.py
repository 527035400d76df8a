"""Semantic constants of the engine, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Thresholds, weights and limits that results depend on.
    blur: float = 100.0
    blur_hard: float = 40.0
    dark: float = 30.0
    bright: float = 225.0
    hash_same: int = 8
    hash_cross: int = 4
    moment_gap_minutes: int = 30
    burst_gap_minutes: int = 2
    burst_sequence_gap: int = 5
    burst_keep: int = 3
    fallback_base: int = 10000
    folder_fallback: bool = True
    select_n: int = 800
    moment_cap: int = 15
    shot_fraction: float = 0.40
    mmr_lambda: float = 0.7
    person_similarity: float = 0.6
    diversity_percent: float = 60.0
    coverage_percent: float = 50.0
    smile: float = 0.7
    weights: dict = field(default_factory=lambda: {"aesthetic": 0.25, "emotion": 0.35, "memorability": 0.15, "rot": 0.10, "prominence": 0.15})
    blend: dict = field(default_factory=lambda: {"brisque": 0.20, "laion": 0.40, "musiq": 0.40})
    candid: float = 1.10
    closed_eyes: float = 0.85
    soft_blur: float = 0.95
    distraction: float = 0.90
    distraction_share: float = 0.20
    thirds_sigma: float = 0.12
    burst_multipliers: tuple = (1.15, 1.05, 0.95)
    burst_compare: int = 4
    burst_groups: tuple = (2, 8)
    review_warning: int = 200
    unknown: str = "unknown"

    @property
    def shot_cap(self) -> int:
        return int(self.shot_fraction * self.select_n)


DEFAULT = Params()
# Status and file-type names.
ALIVE = ("surviving", "soft_blur_surviving")
RAW_EXTENSIONS = ("nef", "cr2", "arw", "dng")
PLAIN_EXTENSIONS = ("jpg", "jpeg", "png")
