"""Search by tree-structured Parzen estimators: settings that did well and those that did not give two densities for each
parameter; of candidates drawn from the first, the one whose ratio of the two is greatest is tried next.

A parameter is a Range or a list of choices. Only scores of settings are kept here, a few numbers for each trial; each trial's
fits run on the cluster. The same seed and scores give the same settings.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from typing import Any

#: Trials drawn at random first, candidates for each parameter, and the share (at most GOOD trials) that counts as good.
STARTUP, CANDIDATES, SHARE, GOOD = 10, 24, 0.1, 25


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    step: float | None = None
    whole: bool = False

    def snapped(self, x: float) -> float:
        """x on the grid of steps, inside the range."""
        step = self.step or (1 if self.whole else None)
        if step is None:
            return min(max(x, self.low), self.high)
        most = math.floor((self.high - self.low) / step + 1e-9)
        k = min(max(round((x - self.low) / step), 0), most)
        return int(self.low + k * step) if self.whole else round(self.low + k * step, 12)

    def drawn(self, rnd: random.Random) -> float:
        step = self.step or (1 if self.whole else None)
        if step is None:
            return rnd.uniform(self.low, self.high)
        return self.snapped(self.low + step * rnd.randint(0, math.floor((self.high - self.low) / step + 1e-9)))


Space = dict[str, Range | list]


def _below(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Parzen:
    """A density over a Range: a normal for each value seen, as wide as the gaps beside it, and a wide one over the range."""

    def __init__(self, over: Range, seen: list[float]):
        self.over, whole = over, (over.high - over.low) or 1.0
        line = sorted(seen)
        edges = [over.low, *line, over.high]
        least = whole / min(100, len(line) + 2)
        self.parts = [(x, min(max(x - edges[k], edges[k + 2] - x, least), whole)) for k, x in enumerate(line)]
        self.parts.append(((over.low + over.high) / 2, whole))

    def drawn(self, rnd: random.Random) -> float:
        center, width = rnd.choice(self.parts)
        for _ in range(100):
            x = rnd.gauss(center, width)
            if self.over.low <= x <= self.over.high:
                break
        return self.over.snapped(x)

    def log(self, x: float) -> float:
        """Log of the density at x, or of the mass of its step of the grid; what lies outside the range is cut off."""
        step, low, high = self.over.step or (1 if self.over.whole else None), self.over.low, self.over.high
        half = (step or 0) / 2
        total = 0.0
        for center, width in self.parts:
            inside = _below((high + half - center) / width) - _below((low - half - center) / width)
            if step is None:
                mass = math.exp(-0.5 * ((x - center) / width) ** 2) / (width * math.sqrt(2 * math.pi))
            else:
                mass = _below((x + half - center) / width) - _below((x - half - center) / width)
            total += mass / max(inside, 1e-12)
        return math.log(max(total / len(self.parts), 1e-300))


class Choices:
    """Shares of choices seen, each counted once more than it was seen."""

    def __init__(self, over: list, seen: list):
        self.over, self.counts = over, [1 + sum(s == c for s in seen) for c in over]

    def drawn(self, rnd: random.Random) -> Any:
        return rnd.choices(self.over, self.counts)[0]

    def log(self, x: Any) -> float:
        return math.log(self.counts[self.over.index(x)] / sum(self.counts))


class Search:
    def __init__(self, space: Space, seed: int, maximise: bool = True):
        self.space, self.maximise, self.rnd, self.tried = space, maximise, random.Random(seed), []

    def ask(self) -> dict[str, Any]:
        """The next setting to try."""
        if len(self.tried) < STARTUP:
            return {n: self.rnd.choice(r) if isinstance(r, list) else r.drawn(self.rnd) for n, r in self.space.items()}
        ranked = sorted(self.tried, key=lambda t: -t[1] if self.maximise else t[1])
        cut = min(math.ceil(SHARE * len(ranked)), GOOD)
        return {n: self._one(r, [t[0][n] for t in ranked[:cut]], [t[0][n] for t in ranked[cut:]]) for n, r in self.space.items()}

    def _one(self, over: Range | list, good: list, bad: list) -> Any:
        kind = Choices if isinstance(over, list) else Parzen
        well, badly = kind(over, good), kind(over, bad)
        return max((well.drawn(self.rnd) for _ in range(CANDIDATES)), key=lambda x: well.log(x) - badly.log(x))

    def tell(self, setting: dict[str, Any], score: float) -> None:
        self.tried.append((setting, score if math.isfinite(score) else (-math.inf if self.maximise else math.inf)))
