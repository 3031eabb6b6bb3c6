"""Hashed character n-grams and a sparse multinomial logistic model.

The model is trained by follow-the-regularised-leader (per-coordinate steps,
elastic-net penalty, weights computed from the sums when they are needed), and
calibrated by one temperature. Training runs in one task over a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Buckets of hashed features.
BUCKETS = 1 << 15
_SHIFT = np.uint64(64 - 15)
#: Fixed odd multipliers of the rolling hash.
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
CHUNK = 1 << 20


def buckets(codes) -> np.ndarray:
    """The bucket of each number, as an n-gram of one."""
    return (((np.asarray(codes, np.uint64) + np.uint64(1)) * _MIX) >> _SHIFT).astype(np.intp)


def ngram_counts(codes: np.ndarray, longest: int = 3) -> np.ndarray:
    """How often each bucket is hit by the n-grams of 1 to `longest` code points; long texts go in chunks."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), CHUNK):
        some = codes[at : at + CHUNK + longest - 1].astype(np.uint64)
        rolled, inside = some + np.uint64(1), min(CHUNK, len(codes) - at)
        for n in range(1, longest + 1):
            if n > 1:
                if len(some) < n:
                    break
                rolled = rolled[:-1] * _STEP + some[n - 1 :] + np.uint64(1)
            begins = rolled[:inside]  # an n-gram counts in the chunk that it begins in
            total += np.bincount(((begins * _MIX) >> _SHIFT).astype(np.intp), minlength=BUCKETS)
    return total


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Ftrl:
    """Sums of a follow-the-regularised-leader run: z and n per feature and class."""

    classes: int
    features: int = BUCKETS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4

    def __post_init__(self) -> None:
        self.z = np.zeros((self.features + 1, self.classes))  # the last row is the intercept
        self.n = np.zeros_like(self.z)

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> None:
        """One step: target holds the probability of each class."""
        index, value = np.append(index, self.features), np.append(value, 1.0)
        w = self.weights(index)
        g = value[:, None] * (softmax(value @ w) - target)
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-(targets * np.log(np.maximum(p, 1e-12))).sum())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def calibration_rows(labels: list[int], most: int = 20_000) -> np.ndarray:
    """Which examples calibrate: every fifth of a label that has ten or more, `most` of all labels at most."""
    seen, total = {}, np.bincount(labels) if labels else np.zeros(0, int)
    each = max(1, most // max(1, np.count_nonzero(total)))
    held = np.zeros(len(labels), bool)
    for i, label in enumerate(labels):
        at = seen[label] = seen.get(label, -1) + 1
        held[i] = total[label] >= 10 and at % 5 == 0 and at // 5 < each
    return held


def fit(
    examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int, epochs: int = 4, held_rows: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and temperature from (indices, values, target) examples.

    Every fifth example calibrates only; with held_rows, those that it names calibrate and the weights are then learnt from all.
    """
    if held_rows is None:
        held = examples[::5] if len(examples) >= 10 else examples
        taught = [x for i, x in enumerate(examples) if i % 5] if len(examples) >= 10 else examples
    else:
        held = [x for x, h in zip(examples, held_rows) if h] or examples
        taught = [x for x, h in zip(examples, held_rows) if not h]
    w = _learn(taught, classes, epochs)
    logits = np.array([np.append(v, 1.0) @ w[np.append(i, len(w) - 1)] for i, v, _ in held])
    t = temperature(logits, np.array([target for _, _, target in held])) if len(held) else 1.0
    if len(taught) < len(examples) and held_rows is not None:
        w = _learn(examples, classes, epochs)
    return w.astype(np.float32), t


def _learn(taught: list[tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int, epochs: int) -> np.ndarray:
    model, order = Ftrl(classes), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(taught)).tolist():
            model.learn(*taught[i])
    return model.weights(slice(None))
