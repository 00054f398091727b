"""Of starts with equal contributions the earliest is dropped, in both forms of a step."""

import numpy as np

from plumbline.operators import kernel

# Two starts that contribute alike, told apart by the side their evidence is on; at 0.5 nothing is won or lost.
HELD = {"start": [3.0, 3.0], "n": [2.0, 2.0], "total": [1.0, 1.0], "square": [0.5, 0.5], "up": [0.0, -1.0], "down": [-1.0, 0.0]}


def test_one_leg():
    state = {f: np.array(v) for f, v in HELD.items()} | {"t": 1, "peak": -np.inf}
    after, _, _, rising = kernel.step(state, 0.5, 0.5, 0.5, most=2)
    assert after["start"].tolist() == [3.0, 1.0] and after["down"].tolist() == [0.0, 0.0] and not rising


def test_legs_together():
    legs = kernel.Legs()
    at = legs.place([("s", "system"), ("s", "anchor")])
    legs.held = {f: np.array([v, v[::-1]]) for f, v in HELD.items()}
    legs.live, legs.t = np.array([2, 2]), np.array([1, 1])
    half = np.full(2, 0.5)
    legs.step(at, half, half, half, 2)
    assert legs.held["start"][:, :2].tolist() == [[3.0, 1.0]] * 2
    assert legs.held["down"][:, 0].tolist() == [0.0, -1.0] and legs.live.tolist() == [2, 2]
