"""Settings of a run, from a JSON file or the defaults; used on the driver only."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Settings:
    neighbours: int = 5
    least_confidence: float = 0.35
    per_class: int = 8
    label_distance: float = 250.0
    merge_distance: int = 40
    crop_padding: int = 20
    least_image_px: int = 300
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    least_per_class: int = 20
    hard_negative_ratio: float = 0.5
    few_shot: tuple[int, ...] = (1, 3, 5, 10)

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        """Values of the file over the defaults; an unknown name is an error."""
        if path is None:
            return cls()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        unknown = set(given) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
