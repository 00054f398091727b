"""The change-point detector for long legs: at most M starts live, the rest dropped for good.

Which starts live depends on the whole history, so a window can't say it. State is a handful of arrays of
at most M numbers per leg. In batch, a task steps all its legs together; `step` is one leg's step, for the
streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .wealth import CUT, EDGE, LEG, MOST_STARTS

FIELDS = ["start", "n", "total", "square", "up", "down"]


def fresh() -> dict:
    return {f: np.zeros(0) for f in FIELDS} | {"t": 0, "peak": -np.inf}


def step(state: dict, x: float, lo: float, hi: float, most: int = MOST_STARTS) -> tuple[dict, float, int, bool]:
    """One observation: open a start, bet, combine, prune. Returns state, log evidence, best start, whether it rises."""
    t = state["t"]
    new = {"start": float(t), "n": 1.0, "total": 0.5, "square": 0.25, "up": 0.0, "down": 0.0}
    a = {f: np.append(state[f], new[f]) for f in FIELDS}
    mean, var = a["total"] / a["n"], a["square"] / a["n"]
    for side, mu in (("up", min(max(hi, EDGE), 1 - EDGE)), ("down", min(max(lo, EDGE), 1 - EDGE))):
        gap = mean - mu
        bet = gap / (var + gap * gap)
        bet = np.clip(bet, 0.0, CUT / mu) if side == "up" else np.clip(bet, -CUT / (1.0 - mu), 0.0)
        a[side] = a[side] + np.log1p(bet * (x - mu))
    a["n"], a["total"] = a["n"] + 1.0, a["total"] + x
    a["square"] = a["square"] + (x - a["total"] / a["n"]) ** 2
    log_e = np.maximum(a["up"], a["down"]) - np.log(2.0)
    value = log_e - np.log(a["start"] + 1.0) - np.log(a["start"] + 2.0)
    if len(value) > most:
        keep = np.sort(np.lexsort((a["start"], value))[-most:])  # of equal ones the earliest goes
        a = {f: v[keep] for f, v in a.items()}
        value, log_e = value[keep], log_e[keep]
    top = value.max()
    combined = float(top + np.log(np.exp(value - top).sum()))
    best = int(np.argmax(log_e))
    out = a | {"t": t + 1, "peak": max(state["peak"], combined)}
    return out, combined, int(a["start"][best]), bool(a["up"][best] >= a["down"][best])


TRACE = "stream_id string, leg string, t long, log_e double, peak_log_e double, alarm boolean, best_start long, direction string"


class Legs:
    """The states of many legs, a row of every array each, stepped together."""

    def __init__(self) -> None:
        self.rows: dict[tuple, int] = {}
        self.held = {f: np.zeros((0, 0)) for f in FIELDS}
        self.live, self.t, self.peak = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def place(self, keys: list[tuple]) -> np.ndarray:
        """The rows of these legs; new ones are added."""
        new = [k for k in keys if k not in self.rows]
        if new:
            n, first = len(new), len(self.rows)
            self.rows.update((k, first + i) for i, k in enumerate(new))
            self.held = {f: np.vstack([a, np.zeros((n, a.shape[1]))]) for f, a in self.held.items()}
            self.live, self.t = (np.concatenate([a, np.zeros(n, np.int64)]) for a in (self.live, self.t))
            self.peak = np.concatenate([self.peak, np.full(n, -np.inf)])
        return np.fromiter((self.rows[k] for k in keys), np.int64, len(keys))

    def step(self, at: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One observation of each of these legs. Returns log evidence, best start, whether it rises; as step() does for one."""
        width = int(self.live[at].max()) + 1
        if width > self.held["n"].shape[1]:
            grown = max(width, 2 * self.held["n"].shape[1])
            self.held = {f: np.pad(a, ((0, 0), (0, grown - a.shape[1]))) for f, a in self.held.items()}
        a = {f: v[at, :width] for f, v in self.held.items()}
        place, live = self.live[at], np.arange(width)[None, :] <= self.live[at][:, None]
        each = np.arange(len(at))
        for f, v in {"start": self.t[at], "n": 1.0, "total": 0.5, "square": 0.25, "up": 0.0, "down": 0.0}.items():
            a[f][each, place] = v
        n = np.where(live, a["n"], 1.0)
        mean, var = a["total"] / n, np.where(live, a["square"] / n, 1.0)
        for side, mu in (("up", np.clip(hi, EDGE, 1 - EDGE)), ("down", np.clip(lo, EDGE, 1 - EDGE))):
            mu = mu[:, None]
            gap = mean - mu
            bet = gap / (var + gap * gap)
            bet = np.clip(bet, 0.0, CUT / mu) if side == "up" else np.clip(bet, -CUT / (1.0 - mu), 0.0)
            a[side] = a[side] + np.log1p(bet * (x[:, None] - mu))
        a["n"], a["total"] = n + 1.0, a["total"] + x[:, None]
        a["square"] = a["square"] + (x[:, None] - a["total"] / a["n"]) ** 2
        log_e = np.where(live, np.maximum(a["up"], a["down"]) - np.log(2.0), -np.inf)
        value = log_e - np.log(a["start"] + 1.0) - np.log(a["start"] + 2.0)
        over = np.flatnonzero(place + 1 > most)
        if len(over):  # one start too many: the least, and of equal ones the earliest, goes for good
            worst = np.argmin(np.where(live, value, np.inf)[over], axis=1)
            shift = np.arange(width)[None, :] + (np.arange(width)[None, :] >= worst[:, None])
            shift = np.minimum(shift, width - 1)
            for v in (*a.values(), log_e, value):
                v[over] = np.take_along_axis(v[over], shift, axis=1)
            log_e[over, width - 1] = value[over, width - 1] = -np.inf
        top = value.max(axis=1)
        combined = top + np.log(np.exp(value - top[:, None]).sum(axis=1))
        best = np.argmax(log_e, axis=1)
        for f, v in a.items():
            self.held[f][at, :width] = v
        self.live[at], self.t[at] = np.minimum(place + 1, most), self.t[at] + 1
        self.peak[at] = np.maximum(self.peak[at], combined)
        return combined, a["start"][each, best].astype(np.int64), a["up"][each, best] >= a["down"][each, best]


def detector_trace(legs: DataFrame, alpha: float, most_starts: int = MOST_STARTS) -> DataFrame:
    """As wealth.detector_trace, for legs of any length. A task's legs come in order of t and are stepped together."""
    limit = float(np.log(1.0 / alpha))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = Legs()
        for batch in batches:
            for t, rows in batch.groupby("t", sort=False):
                keys = list(zip(rows["stream_id"], rows["leg"]))
                at = states.place(keys)
                log_e, best, rising = states.step(at, *(rows[c].to_numpy(float) for c in ("z", "null_lo", "null_hi")), most_starts)
                peak = states.peak[at]
                yield pd.DataFrame({"stream_id": rows["stream_id"].to_numpy(), "leg": rows["leg"].to_numpy(), "t": t, "log_e": log_e, "peak_log_e": peak, "alarm": peak >= limit, "best_start": best, "direction": np.where(rising, "up", "down")})

    rows = legs.select(*LEG, "t", "z", "null_lo", "null_hi").repartition(*LEG).sortWithinPartitions("t")
    return rows.mapInPandas(run, TRACE)
