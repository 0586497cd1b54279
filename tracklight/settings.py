"""Settings of a library's jobs, kept as one JSON file in any file system."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyarrow import fs

#: The bounds of jobs and workers, what a stored name may be, and the defaults.
MOST_JOBS, MOST_WORKERS = 16, 32
CONFLICTS = ("Skip", "Suffix", "Overwrite")
DIRECTORY, FILE = "{album_artist}/{album}", "{track:02d}. {title}"


@dataclasses.dataclass(frozen=True)
class Settings:
    """Values out of bounds are drawn in, unknown names and types become defaults; the split mode is always Hybrid."""

    output_root: str = ""
    directory_template: str = DIRECTORY
    file_template: str = FILE
    conflict_policy: str = "Skip"
    jobs: int = 1
    workers: int = 1
    cue_charset: str | None = None
    copy_cover_art: bool = True
    encoder: str = "ffmpeg"
    last_scan: str = ""
    split_mode: str = "Hybrid"

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value, kind = getattr(self, f.name), type(f.default) if f.default is not None else str
            if value is not f.default and type(value) is not kind:
                object.__setattr__(self, f.name, f.default)
        put = lambda name, value: object.__setattr__(self, name, value)
        put("jobs", min(max(self.jobs, 1), MOST_JOBS))
        put("workers", min(max(self.workers, 1), MOST_WORKERS))
        put("conflict_policy", self.conflict_policy if self.conflict_policy in CONFLICTS else "Skip")
        put("cue_charset", (self.cue_charset or "").strip() and self.cue_charset or None)
        put("split_mode", "Hybrid")


def load(uri: str) -> Settings:
    """What is stored; defaults where there is nothing, or nothing that can be read."""
    store, path = fs.FileSystem.from_uri(uri)
    try:
        with store.open_input_stream(path) as f:
            found = json.loads(f.read())
    except (OSError, ValueError):
        found = {}
    names = {f.name for f in dataclasses.fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in names} if isinstance(found, dict) else {})


def update(uri: str, change: Callable[[Settings], Settings]) -> Settings:
    """The stored settings after a change, written beside their place and moved there."""
    now = change(load(uri))
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".new") as f:
        f.write(json.dumps(dataclasses.asdict(now), indent=1).encode())
    store.move(path + ".new", path)
    return now
