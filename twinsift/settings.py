"""Options of a run, and the profiles that bundle them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MODES = ("SAFE", "AGGRESSIVE", "MEDIA-FOCUSED")


@dataclass(frozen=True)
class Settings:
    min_size: int = 1
    max_size: int = 0
    exclusions: tuple[str, ...] = ()
    skip_system: bool = True
    min_score: int = 70
    min_cluster_sim: float = 0.6
    delete_gap: int = 15
    cleanup_mode: str = "SAFE"
    near: bool = True
    use_sha256: bool = False
    paranoid: bool = False
    semantic: bool = False
    match: str = "substring"
    profile: str = "safe"

    def __post_init__(self) -> None:
        if self.cleanup_mode not in MODES:
            raise ValueError(f"cleanup_mode is one of {', '.join(MODES)}")

    def with_changes(self, **changes) -> Settings:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)


# What the profiles set.
PROFILES = {
    "safe": Settings(profile="safe", min_score=70, cleanup_mode="SAFE", delete_gap=15, paranoid=False, skip_system=True, use_sha256=False, semantic=False),
    "max_safe": Settings(profile="max_safe", min_score=90, cleanup_mode="SAFE", delete_gap=30, paranoid=True, skip_system=True, use_sha256=True, semantic=False),
    "ai_assist": Settings(profile="ai_assist", min_score=80, cleanup_mode="SAFE", delete_gap=20, paranoid=True, skip_system=True, use_sha256=True, semantic=True),
    "performance": Settings(profile="performance", min_score=50, cleanup_mode="AGGRESSIVE", delete_gap=5, paranoid=False, skip_system=False, use_sha256=False, semantic=False),
}
