"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field


def flag(value: str | None, default: bool) -> bool:
    """0, false, no and off are false; unset or blank is the default."""
    return default if value is None or not value.strip() else value.strip().lower() not in ("0", "false", "no", "off")


def first_path(value: str | None, candidates: Iterable[str], exists: Callable[[str], bool]) -> str | None:
    """The path that is set, else the first candidate that exists (asked of the session's own file system), else null."""
    return value if value else next((c for c in candidates if exists(c)), None)


@dataclass(frozen=True)
class Settings:
    """Places and thresholds. Each may be set by an upper-case variable with the prefix."""

    catalogue_path: str = "catalogue.jsonl"
    index_path: str = "index"
    found_probability: float = 0.8
    unknown_below: float = 0.5
    visual_shortlist: int = 30
    text_shortlist: int = 10
    fuzzy: bool = True
    extra: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None, prefix: str = "QUERCUS_") -> Settings:
        source = os.environ if environment is None else environment
        given = {k.removeprefix(prefix).lower(): v for k, v in source.items() if k.startswith(prefix)}
        known = {}
        for name, default in ((n, getattr(cls, n, None)) for n in cls.__dataclass_fields__ if n != "extra"):
            if name in given:
                value = given.pop(name)
                known[name] = flag(value, default) if isinstance(default, bool) else type(default)(value)
        return cls(**known, extra=given)
