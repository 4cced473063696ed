"""Settings of a pipeline, checked before anything runs."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, fields

#: Lexical configurations that the term functions know: fixed values.
LEXICAL = ("simple", "english")
#: Parts of names whose values are secrets and are never written down.
SECRET = ("token", "secret", "password", "api_key", "telemetry")


@dataclass(frozen=True)
class Settings:
    """Sizes, names and limits. A blank secret counts as not set."""

    dimension: int = 64
    encoder_dimension: int = 64
    lexical_config: str = "simple"
    target_tokens: int = 512
    overlap_tokens: int = 64
    max_tokens: int = 512
    min_tokens: int = 64
    query_instruction: str = ""
    api_key: str | None = None

    def __post_init__(self):
        if self.api_key is not None and not self.api_key.strip():
            object.__setattr__(self, "api_key", None)
        if self.dimension != self.encoder_dimension:
            raise ValueError(f"the index holds vectors of {self.dimension}, the encoder gives {self.encoder_dimension}")
        if self.lexical_config not in LEXICAL:
            raise ValueError(f"unknown lexical configuration {self.lexical_config}")
        if self.target_tokens <= 0 or not 0 <= self.overlap_tokens < self.target_tokens:
            raise ValueError("overlap_tokens must be from 0 to below target_tokens")
        if self.max_tokens <= 0 or not 0 <= self.min_tokens < self.max_tokens:
            raise ValueError("min_tokens must be from 0 to below max_tokens")

    def public(self) -> dict[str, object]:
        """What may be stored with a run: everything but secrets."""
        return {f.name: getattr(self, f.name) for f in fields(self) if not any(s in f.name for s in SECRET)}


def git_revision(folder: str = ".") -> str:
    """The checked-out revision of a folder, or unknown outside a checkout."""
    try:
        found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return found.stdout.strip() or "unknown"
