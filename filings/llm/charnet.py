"""A convolutional network over characters that judges findings in their context.

A finding has three parts: the characters before it, its own, and those after it.
Filters of `TAPS` characters slide over each part (one bank over the finding, one
over its surroundings); the largest response of every filter in a part, and the
mean response within the finding, go with its length into one linear unit. A
filter response is a sum of rows of tables, one row for each character below the
filter, so parts of any length lie end to end in one array and none is cut off.

The network is trained on labelled findings. On others, set apart, a logistic
curve maps its output to a probability, and for each kind of finding a threshold
is set: the highest that keeps `RECALL` of the true findings of that kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

TAPS = 5
FILTERS = 24
# Characters around a finding that are looked at.
BEFORE, AFTER = 24, 12
# ASCII from the space on; then line feeds and tabs, other characters, no character.
BREAK, OTHER, NONE = 95, 96, 97
CODES = 98
# Characters whose responses are held in memory at a time.
PIECE = 1 << 15

STEPS = 240
BATCH = 128
RATE = 0.01
DECAY = 1e-4
RECALL = 0.97

_CODE_OF = np.full(128, BREAK)
_CODE_OF[32:127] = np.arange(95)


@dataclass(frozen=True)
class Finding:
    """Text of a finding, what stands around it, and its kind."""

    before: str
    inside: str
    after: str
    kind: str

    @staticmethod
    def of(text: str, start: int, end: int, kind: str) -> Finding:
        return Finding(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER], kind)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.where(points < 128, _CODE_OF[np.minimum(points, 127)], OTHER)


class Parts:
    """Parts end to end; each is followed by one NONE, so that none is empty."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(text) + 1 for text in texts])
        self.starts = np.cumsum(lengths) - lengths
        self.lengths, self.n = lengths, int(lengths.sum())
        # Filters reach over the border of a part into room of their own.
        room = TAPS // 2
        padded = np.full(self.n + 2 * room * len(texts), NONE)
        own = np.arange(self.n) + room * (2 * np.repeat(np.arange(len(texts)), lengths) + 1)
        real = np.ones(self.n, dtype=bool)
        real[self.starts + lengths - 1] = False
        padded[own[real]] = codes("".join(texts))
        self.padded, self.own = padded, own
        self.part = np.repeat(np.arange(len(texts)), lengths)

    def windows(self, low: int, high: int) -> np.ndarray:
        """Codes below the filter at each position: (positions, TAPS)."""
        return self.padded[self.own[low:high, None] + np.arange(TAPS) - TAPS // 2]


def responses(bank: np.ndarray, bias: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.repeat(bias[None], len(windows), axis=0)
    for tap in range(TAPS):
        out += bank[tap][windows[:, tap]]
    return out


def pooled(bank: np.ndarray, bias: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Largest response and mean positive response of each part, in pieces."""
    top = np.full((len(parts.starts), len(bias)), -np.inf)
    total = np.zeros_like(top)
    for low in range(0, parts.n, PIECE):
        high = min(low + PIECE, parts.n)
        out, part = responses(bank, bias, parts.windows(low, high)), parts.part[low:high]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        which = part[first]
        top[which] = np.maximum(top[which], np.maximum.reduceat(out, first, axis=0))
        total[which] += np.add.reduceat(np.maximum(out, 0), first, axis=0)
    return top, total / parts.lengths[:, None]


@dataclass
class Network:
    inside: np.ndarray  # (TAPS, CODES, FILTERS), as the next
    around: np.ndarray
    inside_bias: np.ndarray
    around_bias: np.ndarray
    weights: np.ndarray
    constant: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        bank = lambda: rng.normal(0, 0.3, (TAPS, CODES, FILTERS))
        return Network(
            bank(), bank(), np.zeros(FILTERS), np.zeros(FILTERS), rng.normal(0, 0.1, 4 * FILTERS + 1), np.zeros(1)
        )

    def trained(self) -> list[np.ndarray]:
        return [self.inside, self.around, self.inside_bias, self.around_bias, self.weights, self.constant]

    def features(self, findings: list[Finding]) -> np.ndarray:
        top, mean = pooled(self.inside, self.inside_bias, Parts([f.inside for f in findings]))
        before, _ = pooled(self.around, self.around_bias, Parts([f.before for f in findings]))
        after, _ = pooled(self.around, self.around_bias, Parts([f.after for f in findings]))
        size = np.log2([[len(f.inside) + 1] for f in findings]) / 8
        return np.hstack([np.maximum(top, 0), mean, np.maximum(before, 0), np.maximum(after, 0), size])

    def outputs(self, findings: list[Finding]) -> np.ndarray:
        if not findings:
            return np.zeros(0)
        return self.features(findings) @ self.weights + self.constant[0]

    def chances(self, findings: list[Finding]) -> np.ndarray:
        """Calibrated probability that each finding is a true one."""
        return _logistic(self.slope * self.outputs(findings) + self.offset)

    def accepts(self, findings: list[Finding]) -> np.ndarray:
        least = np.array([self.thresholds.get(f.kind, 0.5) for f in findings])
        return self.chances(findings) >= least

    def gradient(self, findings: list[Finding], labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean logistic loss, for each of `trained()`."""
        x = self.features(findings)
        error = (_logistic(x @ self.weights + self.constant[0]) - labels) / len(labels)
        to_x = error[:, None] * self.weights
        at = [to_x[:, i * FILTERS : (i + 1) * FILTERS] for i in range(4)]
        own, own_bias = self._bank_gradient(self.inside, self.inside_bias, [f.inside for f in findings], at[0], at[1])
        none = np.zeros_like(at[0])
        ahead = self._bank_gradient(self.around, self.around_bias, [f.before for f in findings], at[2], none)
        behind = self._bank_gradient(self.around, self.around_bias, [f.after for f in findings], at[3], none)
        return [own, ahead[0] + behind[0], own_bias, ahead[1] + behind[1], x.T @ error, error.sum(keepdims=True)]

    @staticmethod
    def _bank_gradient(bank, bias, texts: list[str], to_top: np.ndarray, to_mean: np.ndarray):
        parts = Parts(texts)
        windows = parts.windows(0, parts.n)
        out = responses(bank, bias, windows)
        top = np.maximum.reduceat(out, parts.starts, axis=0)
        # Equal responses share the gradient of the largest.
        largest = out == top[parts.part]
        ties = np.add.reduceat(largest.astype(float), parts.starts, axis=0)
        back = largest * (np.where(top > 0, to_top, 0) / ties)[parts.part]
        back += (out > 0) * (to_mean / parts.lengths[:, None])[parts.part]
        tables, filters = np.zeros_like(bank), np.arange(len(bias))
        for tap in range(TAPS):
            place = (windows[:, tap, None] * len(bias) + filters).ravel()
            tables[tap] = np.bincount(place, back.ravel(), CODES * len(bias)).reshape(CODES, -1)
        return tables, back.sum(axis=0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def batches(n: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    while True:
        order = rng.permutation(n)
        for at in range(0, n - BATCH + 1, BATCH):
            yield order[at : at + BATCH]


def train(
    findings: list[Finding], labels: np.ndarray, apart: list[Finding], apart_labels: np.ndarray,
    recall: float = RECALL, seed: int = 42, steps: int = STEPS,
) -> Network:
    """Fit the network on findings, and its probabilities and thresholds on those set apart."""
    net, labels = Network.fresh(seed), np.asarray(labels, dtype=float)
    weights = net.trained()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    chosen = batches(len(findings), np.random.default_rng(seed))
    for step in range(1, steps + 1):
        rows = next(chosen)
        gradient = net.gradient([findings[row] for row in rows], labels[rows])
        for w, m, v, g in zip(weights, mean, square, gradient, strict=True):
            g = g + DECAY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    apart_labels = np.asarray(apart_labels, dtype=float)
    net.slope, net.offset = calibration(net.outputs(apart), apart_labels)
    chances = net.chances(apart)
    for kind in sorted({f.kind for f in apart}):
        own = np.array([f.kind == kind for f in apart]) & (apart_labels == 1)
        if own.any():
            net.thresholds[kind] = threshold(chances[own], recall)
    return net


def calibration(outputs: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton's method.

    Targets are drawn in a little, as without it the curve of two classes that
    lie apart has no bound.
    """
    ones = labels.sum()
    aims = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, at = np.stack([outputs, np.ones_like(outputs)], axis=1), np.array([0.1, 0.0])
    for _ in range(50):
        p = _logistic(x @ at)
        slope = x.T @ (p - aims) + 1e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step * min(1.0, 1 / max(1e-12, np.abs(step).max()))
    return float(at[0]), float(at[1])


def threshold(chances: np.ndarray, recall: float) -> float:
    """The highest threshold that at least a share `recall` of these reach."""
    ranked = np.sort(chances)
    return float(ranked[int(np.floor((1 - recall) * len(ranked) + 1e-9))])
