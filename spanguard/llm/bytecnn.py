"""A small convolutional network over bytes, in numpy.

Filters of several widths slide over the bytes of a window (one-hot, so a filter is
a table of weights by byte and offset); each filter's largest response over the
window, a bias and a rectifier give its feature; a dense layer and softmax give the
classes. Only the place of the largest response gets a gradient, so a training step
touches few weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 256


@dataclass
class Shape:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16

    @property
    def step(self) -> int:
        """Windows overlap, so that each run of bytes that a filter sees is whole in one."""
        return self.window - max(self.widths) + 1


def windows_of(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, windows per text (one at least), and bytes in each."""
    parts, counts, lengths = [], [], []
    overlap = shape.window - shape.step
    for data in texts:
        n = max(1, -(-(len(data) - overlap) // shape.step))
        padded = np.full(n * shape.step + overlap, PAD, np.uint16)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        parts.append(np.lib.stride_tricks.sliding_window_view(padded, shape.window)[:: shape.step])
        counts.append(n)
        lengths.append(np.clip(len(data) - np.arange(n) * shape.step, 1, shape.window))
    if not parts:
        return np.zeros((0, shape.window), np.uint16), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(parts), np.array(counts), np.concatenate(lengths)


def spread_windows(data: bytes, n: int, shape: Shape) -> list[bytes]:
    """At most `n` windows, evenly spread over the whole text."""
    last = max(0, len(data) - shape.window)
    starts = sorted({round(i * last / max(1, n - 1)) for i in range(n)})
    return [data[s : s + shape.window] for s in starts]


class ByteConv:
    """Tables (offset of a width, byte, filter), biases, and the dense layer."""

    def __init__(self, classes: int, shape: Shape, seed: int = 1):
        r = np.random.default_rng(seed)
        self.shape, offsets = shape, sum(shape.widths)
        features = len(shape.widths) * shape.filters
        self.tables = r.normal(0, 0.3, (offsets, PAD + 1, shape.filters)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.bias = np.zeros(features, np.float32)
        self.dense = r.normal(0, features**-0.5, (features, classes)).astype(np.float32)
        self.offset = np.zeros(classes, np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.dense, self.offset]

    def pooled(self, windows: np.ndarray, where: bool = False):
        """The largest response of each filter, and where it is if asked for."""
        most, places, o = [], [], 0
        for w in self.shape.widths:
            n = windows.shape[1] - w + 1
            total = np.take(self.tables[o], windows[:, :n], axis=0)
            for j in range(1, w):
                total += np.take(self.tables[o + j], windows[:, j : n + j], axis=0)
            o += w
            if where:
                place = total.argmax(1)
                places.append(place)
                most.append(np.take_along_axis(total, place[:, None], 1)[:, 0])
            else:
                most.append(total.max(1))
        return np.concatenate(most, 1), places

    def logits(self, windows: np.ndarray, block: int = 8) -> np.ndarray:
        """Few windows at a time, so that their responses stay in the processor's cache.

        The last sums are in doubles: a window's don't depend on those it is taken with.
        """
        dense = self.dense.astype(np.float64)
        out = [
            np.maximum(self.pooled(windows[i : i + block])[0] + self.bias, 0) @ dense + self.offset
            for i in range(0, len(windows), block)
        ]
        return np.concatenate(out) if out else np.zeros((0, len(self.offset)), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        pooled, places = self.pooled(windows, where=True)
        active = np.maximum(pooled + self.bias, 0)
        wrong = softmax(active @ self.dense + self.offset)
        wrong[np.arange(len(target)), target] -= 1
        wrong *= (weight / weight.sum())[:, None]
        back = (wrong @ self.dense.T) * (active > 0)
        tables, o, f = np.zeros_like(self.tables), 0, self.shape.filters
        rows = np.arange(len(windows))[:, None]
        for i, (w, place) in enumerate(zip(self.shape.widths, places)):
            part = back[:, i * f : (i + 1) * f]
            for j in range(w):
                np.add.at(tables, (o + j, windows[rows, place + j], np.arange(f)), part)
            o += w
        tables[:, PAD] = 0
        return [tables, back.sum(0), active.T @ wrong, wrong.sum(0)]

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 2) -> None:
        """Adam over shuffled batches; classes weigh the same however many rows they have."""
        r = np.random.default_rng(seed)
        share = np.bincount(target, minlength=len(self.offset))
        weight = (1 / np.maximum(share, 1))[target].astype(np.float32)
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        steps, step = epochs * -(-len(windows) // batch), 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for w, g, m, v in zip(self.weights, self.gradients(windows[some], target[some], weight[some]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))
