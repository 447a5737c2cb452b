"""A mergeable sketch of a column's order with certified error, and the brackets it gives for ranks.

Values are held in levels; one of level l stands for 2**l values. A full level is sorted and every second value moves a level
up, which shifts the rank of any value by 2**l at most, however many values move (Karnin, Lang and Liberty 2016 choose the
half at random; here halves alternate and every shift is booked). So the sketch knows how wrong it may be, and a wanted
rank is certain to lie between two of its values.
"""

import pickle

import numpy as np

#: Values that a level holds before it is halved.
LEVEL_VALUES = 1 << 15


class RankSketch:
    def __init__(self, level_values: int = LEVEL_VALUES):
        self.size, self.levels, self.odd = level_values, [np.zeros(0)], [False]
        self.rows, self.low, self.high, self.error = 0, np.inf, -np.inf, 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.rows += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._settle()

    def merge(self, other: "RankSketch") -> None:
        self.rows, self.error = self.rows + other.rows, self.error + other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self._grow()
        for k, values in enumerate(other.levels):
            self.levels[k] = np.concatenate([self.levels[k], values])
        self._settle()

    def _grow(self) -> None:
        self.levels.append(np.zeros(0))
        self.odd.append(False)

    def _settle(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.size:
                if k + 1 == len(self.levels):
                    self._grow()
                values = np.sort(self.levels[k])
                # one value stays where their number is odd, so that weights add up to the rows
                stay, values = values[:len(values) % 2], values[len(values) % 2:]
                self.levels[k] = stay
                self.levels[k + 1] = np.concatenate([self.levels[k + 1], values[int(self.odd[k])::2]])
                self.odd[k] = not self.odd[k]
                self.error += 1 << k
            k += 1

    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct values in order, and all weight up to and with each."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << k, np.int64) for k, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        last = np.append(values[1:] != values[:-1], True) if len(values) else np.zeros(0, bool)
        return values[last], upto[last]

    def brackets(self, ranks: list[int]) -> list[tuple[float, float]]:
        """For each rank (from 0) two values: the one of that rank is above the first and at most the second."""
        values, upto = self._ranked()
        out = []
        for r in ranks:
            below = int(np.searchsorted(upto, r + 1 - self.error, "left"))  # so many values have upto + error < r + 1
            above = int(np.searchsorted(upto, r + 1 + self.error, "left"))
            out.append((float(values[below - 1]) if below else -np.inf, float(values[above]) if above < len(values) else self.high))
        return out

    def most_values(self, spans: list[tuple[float, float]]) -> int:
        """Distinct values above the first and at most the second bound of all spans together, at most.

        Between two neighbours of the sketch lie 2 * error rows at most, so that values with many rows count once.
        """
        values, upto = self._ranked()
        upto, total = np.concatenate([[0], upto]), 0
        for low, high in spans:
            first = int(np.searchsorted(values, low, "right"))
            stop = max(first, int(np.searchsorted(values, high, "left")))
            rows = int(upto[stop] - upto[first]) + 2 * self.error + 1
            total += min(rows, (stop - first + 1) * (2 * self.error + 1))
        return total

    def dumps(self) -> bytes:
        return pickle.dumps((self.size, self.levels, self.odd, self.rows, self.low, self.high, self.error))

    @classmethod
    def loads(cls, raw: bytes) -> "RankSketch":
        out = cls()
        out.size, out.levels, out.odd, out.rows, out.low, out.high, out.error = pickle.loads(raw)
        return out
