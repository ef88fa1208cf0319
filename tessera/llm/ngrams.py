"""Hashed character n-grams of batches of texts, and a linear classifier scaled by naive Bayes ratios.

A feature is the log density of an n-gram of code points in a text, lower-cased
(A-Z) and with runs of white space as one space, a space at either end. It is
scaled by its log-count ratio r between the classes; a logistic regression is
then fitted on the scaled features (Wang and Manning, 2012).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.textblocks import gathered, mixed, utf8, words

SIZES, BITS = (3, 4, 5, 6), 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of normalised texts, each with a space before and after."""
    raw, offsets = utf8(column)
    w = words(_LOWER[raw], offsets)
    joined, at = gathered(w.raw, w.start, w.end, w.first)
    n = len(at) - 1
    padded = np.full(len(joined) + 2 * n, 0x20, np.uint8)
    padded[np.arange(len(joined)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = joined
    ends = at + 2 * np.arange(n + 1)
    points = np.frombuffer(padded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((padded & 0xC0) != 0x80)))
    return points, before[ends]


def hits(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of each distinct pair; only features that `keep` marks, where given."""
    width, found = np.uint64(64 - bits), []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = mixed(points.astype(np.uint64) + np.uint64(1))
    rolled = value
    for n in range(2, max(sizes) + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n not in sizes:
            continue
        feature = ((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> width
        same = owner[: len(feature)] == owner[n - 1 :]
        chosen = np.flatnonzero(same & keep[feature] if keep is not None else same)
        found.append((owner[chosen].astype(np.uint64) << np.uint64(bits)) | feature[chosen])
    pairs, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64), times


def fit_logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, weight: np.ndarray | None = None, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sparse rows; accelerated gradient descent."""
    n = len(target)
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    square = np.bincount(row, value * value, n)
    step = 1.0 / (0.25 * (np.percentile(square, 95) + 1.0) + penalty)
    w, b = np.zeros(width), float(np.log((weight @ target + 1) / (weight @ (1 - target) + 1)))
    v, c = w.copy(), b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[column] * value, n) + c, -40, 40)))
        error = weight * (p - target) / total
        w_new = v - step * (np.bincount(column, error[row] * value, width) + penalty * v)
        b_new = c - step * error.sum()
        pull = k / (k + 3)
        v, c = w_new + pull * (w_new - w), b_new + pull * (b_new - b)
        w, b = w_new, b_new
    return w, b


def strength(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Value of an n-gram before scaling: the logarithm of its density in the text."""
    return np.log1p(times * 1000.0 / (length + 300.0))


@dataclass
class NgramModel:
    """A weight per hashed n-gram and an intercept."""

    weights: np.ndarray
    intercept: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def margins(self, column: pa.Array) -> np.ndarray:
        points, offsets = code_points(column)
        row, feature, times = hits(points, offsets, self.weights != 0, self.sizes, self.bits)
        return np.bincount(row, self.weights[feature] * strength(times, np.diff(offsets)[row]), len(offsets) - 1) + self.intercept


def batched(texts: list[str | None], limit: int = 1 << 20):
    """(first index, column) of stretches of texts of about `limit` characters."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held > limit:
            yield begin, pa.array(texts[begin : k + 1], pa.large_string())
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, pa.array(texts[begin:], pa.large_string())


def fit_ngrams(texts: list[str | None], target: np.ndarray, features: int = 30_000, alpha: float = 1.0, penalty: float = 1e-5, rare: float = 4.0, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> NgramModel:
    """Naive Bayes log-count ratios, the `features` most telling n-grams, then logistic regression on them.

    Rows of class 1, where it is the rarer, weigh up to `rare` times as much.
    """
    target = np.asarray(target, float)
    if not len(texts) or target.min() == target.max():
        share = float(target.mean()) if len(texts) else 0.0
        return NgramModel(np.zeros(1 << bits, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), bits, sizes)
    count, seen = np.zeros((2, 1 << bits)), np.zeros(1 << bits, np.int64)
    for begin, column in batched(texts):
        points, offsets = code_points(column)
        row, feature, times = hits(points, offsets, None, sizes, bits)
        value = strength(times, np.diff(offsets)[row])
        seen += np.bincount(feature, minlength=1 << bits)
        for side in (0, 1):
            of = target[begin + row] == side
            count[side] += np.bincount(feature[of], value[of], 1 << bits)
    ratio = np.log((count[1] + alpha) / (count[1].sum() + alpha)) - np.log((count[0] + alpha) / (count[0].sum() + alpha))
    telling = np.where(seen >= 3, np.abs(ratio) * np.sqrt(np.minimum(count[0], count[1].sum()) + count[1]), 0)
    chosen = np.zeros(1 << bits, bool)
    chosen[np.argsort(-telling, kind="stable")[:features]] = True
    chosen &= telling > 0
    place = np.cumsum(chosen) - 1
    rows, columns, values = [], [], []
    for begin, column in batched(texts):
        points, offsets = code_points(column)
        row, feature, times = hits(points, offsets, chosen, sizes, bits)
        rows.append(begin + row)
        columns.append(feature)
        values.append(strength(times, np.diff(offsets)[row]))
    row, feature, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    w, b = fit_logistic(row, place[feature], ratio[feature] * value, target, int(chosen.sum()), np.where(target == 1, min(rare, max(1.0, (1 - target).sum() / target.sum())), 1.0), penalty)
    weights = np.zeros(1 << bits, np.float32)
    weights[chosen] = (w * ratio[chosen]).astype(np.float32)
    return NgramModel(weights, b, bits, sizes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))
