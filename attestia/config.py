"""Settings of a matter: a JSON file over defaults, found in the folder or one above it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

NAME = "attestia.json"


@dataclass
class Config:
    """Paths are relative to root, the folder of the file."""

    root: str = "."
    sources: list[str] = field(default_factory=lambda: ["law"])
    drafts: list[dict] = field(default_factory=lambda: [{"tier": "A", "path": "case"}, {"tier": "B", "path": "guides"}, {"tier": "C", "path": "research"}])
    bank: str = "case/QUOTE-BANK.md"
    queue: str = "case/QUOTE-QUEUE.md"
    library_index: str = "law/INDEX.md"
    registry: str = "law/registry.json"
    citation_packs: list[str] = field(default_factory=lambda: ["us-federal"])
    surnames: list[str] = field(default_factory=list)
    min_quote_length: int = 45
    drop_cyrillic_quotes: bool = False
    skip_dirs: list[str] = field(default_factory=lambda: [".git", "node_modules", "__pycache__", ".venv", "venv", "archive", "_archive"])
    guard_watch: list[str] = field(default_factory=lambda: ["case", "guides"])
    guard_ignore: list[str] = field(default_factory=lambda: ["research", "archive", "_archive", "answers"])

    def path(self, relative: str) -> str:
        return relative if os.path.isabs(relative) or "://" in relative else os.path.join(self.root, relative)

    def missing(self) -> list[str]:
        """The folders named that are not there."""
        return [p for p in [*self.sources, *(d["path"] for d in self.drafts)] if "://" not in p and not os.path.isdir(self.path(p))]


def load(start: str = ".") -> Config:
    """The settings of start, a file or a folder; keys that begin with an underscore are comments, unknown ones an error."""
    path = start if os.path.isfile(start) else find(start)
    if path is None:
        return Config(os.path.abspath(start))
    with open(path, encoding="utf-8") as f:
        given = {k: v for k, v in json.load(f).items() if not k.startswith("_")}
    known = {x.name for x in fields(Config)}
    if extra := sorted(given.keys() - known):
        raise ValueError(f"{path} has unknown settings: {', '.join(extra)}")
    return Config(**{"root": os.path.dirname(os.path.abspath(path)), **given})


def find(folder: str) -> str | None:
    """The nearest file of settings in a folder or above it."""
    folder = os.path.abspath(folder)
    while not os.path.isfile(os.path.join(folder, NAME)):
        if os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)
    return os.path.join(folder, NAME)
