"""A small perceptron on a date's cross section, trained for the rank-weighted correlation; numpy on bounded input, inference by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hidden layers.
HIDDEN = (256, 128, 32)


def wpcc_gradient(pred: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The negative rank-weighted correlation of one date, and its gradient; the weights count as constant."""
    n = len(pred)
    k = np.ones(n)
    if n > 1:
        k[np.argsort(-pred, kind="stable")] = 0.5 ** np.linspace(0, 1, n)
    k /= k.sum()
    cov = (k * pred * y).sum() - (k * pred).sum() * (k * y).sum()
    pc, yc = pred - pred.mean(), y - y.mean()
    sp, sy = np.sqrt((k * pc * pc).sum()), np.sqrt((k * yc * yc).sum())
    if sp * sy == 0:
        return 0.0, np.zeros(n)
    below = sp * sy + 1e-12
    d_cov = k * y - k * (k * y).sum()
    d_sp = (k * pc - (k * pc).sum() / n) / sp
    return -cov / below, -(d_cov / below - cov * sy * d_sp / below**2)


class Perceptron:
    def __init__(self, inputs: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 42) -> None:
        draw = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        self.layers = [(draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i + 1 < len(self.layers) else z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def fit(self, dates: list[tuple[np.ndarray, np.ndarray]], epochs: int = 60, rate: float = 1e-3, decay: float = 1e-4) -> list[float]:
        """AdamW over dates' (features, label); the mean loss of each epoch."""
        first = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        second = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        losses, step = [], 0
        for _ in range(epochs):
            total = 0.0
            for x, y in dates:
                step += 1
                out = self.forward(x)
                loss, g = wpcc_gradient(out[-1][:, 0], y)
                total += loss
                g = g[:, None]
                for i in range(len(self.layers) - 1, -1, -1):
                    w, b = self.layers[i]
                    grads = (out[i].T @ g, g.sum(0))
                    g = (g @ w.T) * (out[i] > 0)
                    new = []
                    for j, p in enumerate((w, b)):
                        first[i][j] = 0.9 * first[i][j] + 0.1 * grads[j]
                        second[i][j] = 0.999 * second[i][j] + 0.001 * grads[j] ** 2
                        move = (first[i][j] / (1 - 0.9**step)) / (np.sqrt(second[i][j] / (1 - 0.999**step)) + 1e-8)
                        new.append(p - rate * (move + decay * p))
                    self.layers[i] = tuple(new)
            losses.append(total / max(1, len(dates)))
        return losses


def predict(df: DataFrame, model: Perceptron, names: list[str], fold: int = 1) -> DataFrame:
    """(date, code, fold, value) of normalised rows (date, code, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.predict(x))], names=["date", "code", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = df.select("date", "code", *names).mapInArrow(run, f"date {kinds['date']}, code {kinds['code']}, value double")
    return out.select("date", "code", F.lit(fold).alias("fold"), "value")


def best_checkpoint(names: list[str]) -> str | None:
    """The name with the largest val_wei=NUMBER in it; None if none has one."""
    scored = [(float(m.group(1)), n) for n in names if (m := re.search(r"val_wei=(-?\d+(?:\.\d+)?)", n))]
    return max(scored)[1] if scored else None
