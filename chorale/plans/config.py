"""Typed settings with bounds, read over defaults (SRC15, SNK9, FLT20, PRJ12, NUM4)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Ranking:
    relevance: float = 0.35
    quality: float = 0.25
    popularity: float = 0.20
    metadata: float = 0.20

    def normal(self) -> tuple[float, float, float, float]:
        """The weights over their sum; equal ones where the sum is not above zero."""
        parts = (self.relevance, self.quality, self.popularity, self.metadata)
        total = sum(parts)
        return tuple(p / total for p in parts) if total > 0 else (0.25,) * 4


@dataclass
class Ladder:
    channel: float = 0.75
    rules: float = 0.65
    releases: float = 0.60
    most_candidates: int = 10


@dataclass
class Settings:
    least_seconds: int = 45
    most_seconds: int = 900
    as_of: str = "2025-07-01"
    shuffle_partitions: int = 200
    max_results: int = 100
    cache_seconds: int = 3600
    ranking: Ranking = field(default_factory=Ranking)
    ladder: Ladder = field(default_factory=Ladder)


#: name: (least, most)
BOUNDS = {
    "least_seconds": (0, 3600), "most_seconds": (1, 86_400), "shuffle_partitions": (1, 1_000_000), "max_results": (1, 1000), "cache_seconds": (1, 31_536_000), "ladder.channel": (0, 1), "ladder.rules": (0, 1),
    "ladder.releases": (0, 1), "ladder.most_candidates": (1, 100), "ranking.relevance": (0, 1), "ranking.quality": (0, 1), "ranking.popularity": (0, 1), "ranking.metadata": (0, 1),
}


def merged(base: dict, over: dict) -> dict:
    """`over` on top of `base`, table by table."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _filled(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    default = kind()
    return kind(**{k: _filled(type(getattr(default, k)), v) if is_dataclass(getattr(default, k)) else v for k, v in values.items() if k in known})


def checked(s: Settings) -> Settings:
    for name, (low, high) in BOUNDS.items():
        value = s
        for part in name.split("."):
            value = getattr(value, part)
        if not isinstance(value, (int, float)) or isinstance(value, bool) or not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}, not {value!r}")
    if s.least_seconds > s.most_seconds:
        raise ValueError("least_seconds must not exceed most_seconds")
    return s


def settings(path: str | None = None, **over) -> Settings:
    """Defaults, then a JSON file, then `over`; names that are no setting are left out."""
    given = json.loads(Path(path).read_text()) if path else {}
    return checked(_filled(Settings, merged(merged(asdict(Settings()), given), over)))


def write_template(path: str) -> None:
    Path(path).write_text(json.dumps(asdict(Settings()), indent=2) + "\n")
