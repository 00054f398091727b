"""Settings, strict about names and ranges: an unknown key is an error, nothing is guessed."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from .functions.scores import VERDICTS
from .plans.attribution import Config as PlanConfig

ADAPTERS = ["jsonl", "promptfoo", "deepeval", "inspect"]


@dataclass(frozen=True)
class Settings:
    adapter: str = "jsonl"
    scale: tuple[float, float] = (0.0, 1.0)
    alpha: float = 0.05
    target: float = 0.05
    min_runs: int = 8
    min_obs: int = 30
    baseline_runs: int = 8
    anchor_n: int = 260
    replicates: int = 5
    cadence: int = 1
    seed: int = 0
    horizon: int = 50
    most_starts: int = 256
    fail_on: list[str] = field(default_factory=lambda: ["system", "both"])
    warn_on: list[str] = field(default_factory=lambda: ["judge", "indeterminate"])

    def __post_init__(self) -> None:
        wrong = []
        if self.adapter not in ADAPTERS:
            wrong.append(f"adapter must be one of {', '.join(ADAPTERS)}")
        if not 0 < self.alpha <= 0.5:
            wrong.append("alpha must lie in (0, 0.5]")
        if not self.scale[0] < self.scale[1]:
            wrong.append("scale must be ordered")
        if self.min_runs < 2 or self.min_obs < 1 or self.replicates < 2 or self.cadence < 1:
            wrong.append("min_runs >= 2, min_obs >= 1, replicates >= 2 and cadence >= 1 are needed")
        if set(self.fail_on) & set(self.warn_on):
            wrong.append("fail_on and warn_on overlap")
        if "stable" in self.fail_on:
            wrong.append("stable can't fail a gate")
        if not {*self.fail_on, *self.warn_on} <= set(VERDICTS):
            wrong.append(f"verdicts are {', '.join(VERDICTS)}")
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def parse(cls, text: str) -> Settings:
        data = json.loads(text)
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if k == "scale" else v for k, v in data.items()})

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def plan(self, long: bool = False) -> PlanConfig:
        return PlanConfig(self.alpha, self.target, self.baseline_runs, self.replicates, self.min_runs, self.min_obs, self.most_starts, "kernel" if long else "windows")
