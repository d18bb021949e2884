"""Settings of one deployment. Hosts, key shapes and page selectors live here and nowhere else."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    hosts: tuple[str, ...] = ("lists.example",)
    listing_paths: tuple[str, ...] = ("/list", "/top")
    item_path: str = "/view"
    key_param: str = "key"
    key_field: str = "viewkey"
    class_param: str = "c"
    preferred_class: str = "visible"
    page_param: str = "page"
    key_pattern: str = r"\A[A-Za-z0-9_-]{6,64}\z"
    overlay_pattern: str = r"thumb_(\d+)"
    title_class: str = "title"
    duration_class: str = "duration"
    media_extensions: tuple[str, ...] = ("mp4", "webm", "mov", "m4v", "mkv")
    default_extension: str = "mp4"
    safe_kinds: tuple[str, ...] = ("media_mismatch", "media_unavailable")
    mismatch_phrase: str = "does not match the listing"
    unavailable_text: str = "media is not available"
    signature_keys: tuple[str, ...] = ("st", "f", "e", "sig", "signature", "token")
    playable_extensions: tuple[str, ...] = ("mp4", "m4v", "webm")
    fragment_calls: tuple[str, ...] = ("strencode2", "strencode")
    challenge_marks: tuple[str, ...] = ("just a moment", "checking your browser", "captcha")
    score_weights: dict[str, int] = field(default_factory=lambda: {"consistent": 16, "preferred": 8, "title": 2, "thumbnail": 1, "duration": 1})
    detector_version: int = 3
    stale_hours: float = 26.0
    history_days: int = 14
    recent_files: int = 12
    pending_rows: int = 50
    retained_backups: int = 7
    max_sources: int = 20
    max_pages: int = 20


DEFAULT = Settings()
