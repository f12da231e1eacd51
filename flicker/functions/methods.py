"""The catalogue of smoothing and sharpening methods: parameters, kernels and formulas."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the parameter grids, and the order in which ties between families are resolved.
TIMES = (1, 2, 4, 8, 16, 32, 64)
ALPHAS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 8.0)
SIGMAS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
WIDTHS = (3, 5, 9, 17, 33, 65, 129)
FAMILIES = ("raw", "linear", "cubic_median", "oracle_debiased_linear", "hard_linear", "moving_average", "gaussian", "median", "power_full", "power_matched")
CONTROLS = ("raw", "linear", "hard_linear", "moving_average", "gaussian", "median", "power_full", "power_matched")
PARAMETERS = {
    "raw": (), "linear": ("t",), "cubic_median": ("t",), "oracle_debiased_linear": ("t",), "hard_linear": ("t",), "moving_average": ("half_width",),
    "gaussian": ("sigma",), "median": ("width",), "power_full": ("t", "alpha"), "power_matched": ("t",),
}
LEAST_WEIGHT = 1e-16


@dataclass(frozen=True)
class Method:
    """A method and its parameters; cand is its place in the grid of its family."""

    name: str
    cand: int = 0
    params: tuple[tuple[str, float], ...] = field(default=())

    def __post_init__(self):
        if self.name not in PARAMETERS:
            raise ValueError(f"unknown method {self.name!r}")
        p = dict(self.params)
        if set(p) != set(PARAMETERS[self.name]):
            raise ValueError(f"{self.name} takes {PARAMETERS[self.name]}, got {tuple(p)}")
        for k, v in p.items():
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
                raise ValueError(f"{k} must be a positive number, got {v!r}")
            if k in ("t", "half_width", "width") and v != int(v):
                raise ValueError(f"{k} must be whole, got {v!r}")
        if self.name == "median" and int(p["width"]) % 2 == 0:
            raise ValueError("width must be odd")

    def __getitem__(self, key: str) -> float | None:
        return dict(self.params).get(key)

    @property
    def kernel(self) -> tuple[str, float]:
        """What is convolved before the pointwise formula: methods of one kernel share it."""
        if self.name == "raw":
            return ("raw", 0.0)
        if self.name in ("moving_average", "gaussian", "median"):
            return (self.name, float(self.params[0][1]))
        return ("resolvent", float(self["t"]))


def method(name: str, cand: int = 0, **params: float) -> Method:
    return Method(name, cand, tuple(sorted(params.items())))


def candidates(noise_level: float | None = None) -> list[Method]:
    """The whole grid: 120 methods where the noise level is known (below 0.5), else 113."""
    out = []
    for name in FAMILIES:
        if name == "oracle_debiased_linear" and (noise_level is None or not 0 <= noise_level < 0.5):
            continue
        if name == "raw":
            grid = [{}]
        elif name == "moving_average":
            grid = [{"half_width": w} for w in TIMES]
        elif name == "gaussian":
            grid = [{"sigma": s} for s in SIGMAS]
        elif name == "median":
            grid = [{"width": w} for w in WIDTHS]
        elif name == "power_full":
            grid = [{"t": t, "alpha": a} for t in TIMES for a in ALPHAS]
        else:
            grid = [{"t": t} for t in TIMES]
        out += [method(name, i, **g) for i, g in enumerate(grid)]
    return out


def kernel_weights(kind: str, param: float) -> np.ndarray:
    """Weights of offsets -W .. W; the resolvent is a two-sided exponential cut below LEAST_WEIGHT."""
    if kind == "raw":
        return np.ones(1)
    if kind in ("moving_average", "median"):
        w = int(param) if kind == "moving_average" else int(param) // 2
        return np.full(2 * w + 1, 1 / (2 * w + 1))
    if kind == "gaussian":
        w = int(4 * param + 0.5)
        g = np.exp(-0.5 * (np.arange(-w, w + 1) / param) ** 2)
        return g / g.sum()
    s = math.sqrt(1 + param)
    r = (s - 1) / (s + 1)
    w = math.ceil(math.log(LEAST_WEIGHT) / math.log(r))
    return r ** np.abs(np.arange(-w, w + 1)) / s


def halo(methods: list[Method]) -> int:
    """Frames that the widest kernel needs on either side."""
    return max((len(kernel_weights(*m.kernel)) // 2 for m in methods), default=0)


def log_odds(h: np.ndarray) -> np.ndarray:
    """ln((1 - h) / h): what all power methods of one kernel share; infinite at 0 and 1."""
    h = np.clip(h, 0.0, 1.0)
    with np.errstate(divide="ignore"):
        return np.log1p(-h) - np.log(h)


def shape(m: Method, h: np.ndarray, noise_level: float | None = None, odds: np.ndarray | None = None) -> np.ndarray:
    """The pointwise formula on the convolved series; odds: log_odds(h), if it is known."""
    if m.name == "median":  # binary input: the majority of an odd window
        return (h > 0.5).astype(float)
    h = np.clip(h, 0.0, 1.0)
    if m.name == "cubic_median":
        return h * h * (3 - 2 * h)
    if m.name == "oracle_debiased_linear":
        if noise_level is None or not 0 <= noise_level < 0.5:
            raise ValueError("the noise level must be known and below 0.5")
        return np.clip((h - noise_level) / (1 - 2 * noise_level), 0.0, 1.0)
    if m.name == "hard_linear":
        return at_least_half(h).astype(float)
    if m.name in ("power_full", "power_matched"):
        a = 3.0 if m.name == "power_matched" else float(m["alpha"])
        if a == 1.0:
            return h
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(a * (log_odds(h) if odds is None else odds)))
    return h


def at_least_half(p: np.ndarray) -> np.ndarray:
    """p >= 0.5, with values within 5e-13 of the tie counted as the tie."""
    return p >= 0.5 - 5e-13
