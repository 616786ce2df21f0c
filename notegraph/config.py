"""Settings of a publish plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PlanConfig:
    """``folder`` is a raw string prefix of paths; the empty string is everything."""

    folder: str = ""
    publish_key: str = "publish"
    use_h1: bool = False
    deduplicate_titles: bool = True
    preserve_folders: bool = True
    metadata_panel: bool = False
    labels_from_taxonomy: bool = False
    label_fields: tuple[str, ...] = ("subject", "type")
    quality: str = "high"
    batch_size: int = 20
    skip_unchanged: bool = True
    force: bool = False
    orphan_mode: str = "report"  # off, report, archive, trash
    removal_cap: int = 25  # 0: no cap
