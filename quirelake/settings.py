"""Settings from a TOML text, read on the driver: access rules, the embedding model, the size of answers."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

#: Bytes of an answer's text if nothing is set, and the least and the greatest that can be.
ANSWER_BYTES, LEAST_BYTES, MOST_BYTES = 200_000, 4_096, 2_000_000


@dataclass(frozen=True)
class Settings:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    model: str | None = None
    answer_bytes: int = ANSWER_BYTES


def parse(text: str | None) -> Settings:
    """No text permits everything; a text that isn't TOML, or has values of another kind, is an error, not a default."""
    if text is None:
        return Settings()
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"the settings aren't TOML: {error}") from error
    paths, size = raw.get("paths", {}), raw.get("limits", {}).get("max_response_bytes", ANSWER_BYTES)
    rules = [tuple(paths.get(k, [])) for k in ("allow", "deny")]
    if not all(isinstance(p, str) for r in rules for p in r) or not isinstance(size, int) or isinstance(size, bool):
        raise ValueError("the settings have a value of a kind that doesn't fit")
    return Settings(*rules, raw.get("embedding", {}).get("model"), max(LEAST_BYTES, min(MOST_BYTES, size)))
