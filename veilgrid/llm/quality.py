"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees of at most three leaves are boosted feature
by feature, round after round, each on the residuals that the others leave, and all trees
of a feature add up to one table over its bins. Pairs of features whose joint cells still
explain residuals get tables of their own. Scoring is bin lookups and additions.

Cases: a null text is an empty one, whose features are all 0; with no labelled rows, or
one label only, every text gets the share of label 1 (0 without rows); rows with a null
label are not learned from; repeated rows each get their row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, map_rows

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_next", "upper", "symbols", "digits",
    "pipes", "shouts", "distinct_lines", "stops", "odd_ends", "short_words", "long_words", "pair_repeats",
)
#: Class of each byte: 1 lower case, 2 upper case, 3 digit, 4 white space, 5 full stop or comma, 6 other ASCII, 0 beyond ASCII.
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[33:127] = 6
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 1, 2, 3
BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = 4
BYTE_CLASS[[44, 46]] = 5


def features(text: str | None) -> list[float]:
    """The features of a whole text, as in ``FEATURES``."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, total = len(words), len(data)
    kinds = np.bincount(BYTE_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    letters = max(1, int(kinds[0] + kinds[1] + kinds[2]))
    lines = data.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    odd = BYTE_CLASS[ends] == 6
    pairs = set(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(total)), float(np.log1p(n)), float(lengths.mean()), len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, kinds[2] / letters, kinds[6] / total, kinds[3] / total,
        data.count(b"|") / n, data.count(b"!") / n, len(set(lines)) / len(lines), kinds[5] / n,
        float(odd.mean()), float((lengths <= 3).mean()), float((lengths > 12).mean()), 1 - len(pairs) / max(1, n - 1),
    ]


@dataclass(frozen=True)
class QualityModel:
    """``edges`` and ``tables`` by feature, ``pairs`` of feature numbers with their grids, an intercept."""

    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_edges: tuple[np.ndarray, ...]
    grids: tuple[np.ndarray, ...]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values over bins of the best tree with at most three leaves."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best_cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        k = np.arange(lo + 1, hi)
        gl, hl, gr, hr = cg[k] - cg[lo], ch[k] - ch[lo], cg[hi] - cg[k], ch[hi] - ch[k]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
        at = int(gain.argmax())
        return float(gain[at]), int(k[at])

    n = len(g)
    _, first = best_cut(0, n)
    cuts = {0, n, first}
    (left, a), (right, b) = best_cut(0, first), best_cut(first, n)
    if max(left, right) > 0:
        cuts.add(a if left >= right else b)
    out, marks = np.zeros(n), sorted(cuts)
    for lo, hi in zip(marks, marks[1:], strict=False):
        if hi > lo:
            out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four cells by one cut on either side."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))
    best, out = 0.0, np.zeros_like(g)
    rows, cols = g.shape
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    for i in range(1, rows):
        for j in range(1, cols):
            cells = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*cells, strict=True)) - whole
            if gain > best:
                v = [a / (b + ridge) for a, b in zip(*cells, strict=True)]
                best = gain
                out = np.block([[np.full((i, j), v[0]), np.full((i, cols - j), v[1])], [np.full((rows - i, j), v[2]), np.full((rows - i, cols - j), v[3])]])
    return best, out


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> QualityModel:
    """Boost the tables on a sample held in memory."""
    n, width = x.shape
    share = float(np.clip(y.mean() if n else 0.0, 1e-9, 1 - 1e-9))
    base = float(np.log(share / (1 - share)))
    edges = tuple(_cut_points(x[:, f], bins) if n else np.zeros(0) for f in range(width))
    pair_edges = tuple(_cut_points(x[:, f], pair_bins) if n else np.zeros(0) for f in range(width))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return QualityModel(edges, tuple(tables), (), pair_edges, (), base)
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    z = np.full(n, base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = slope()
            size = len(tables[f])
            step = rate * _shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), ridge)
            tables[f] += step
            z += step[at[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(pair_edges[a]) + 1, len(pair_edges[b]) + 1
        return coarse[a] * shape[1] + coarse[b], shape

    g, h = slope()
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            where, shape = cells(a, b)
            size = shape[0] * shape[1]
            gains.append((_quadrants(np.bincount(where, g, size).reshape(shape), np.bincount(where, h, size).reshape(shape), ridge)[0], a, b))
    chosen = tuple((a, b) for gain, a, b in sorted(gains, reverse=True)[:pairs] if gain > 0)
    grids = [np.zeros(cells(a, b)[1]) for a, b in chosen]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(chosen):
            g, h = slope()
            where, shape = cells(a, b)
            size = shape[0] * shape[1]
            step = rate * _quadrants(np.bincount(where, g, size).reshape(shape), np.bincount(where, h, size).reshape(shape), ridge)[1]
            grids[k] += step
            z += step.ravel()[where]
    return QualityModel(edges, tuple(tables), chosen, pair_edges, tuple(grids), base)


def fit(df: DataFrame, label: Column, text_col: str = "text") -> QualityModel:
    """Learn from labelled rows (``common.labelled_sample`` bounds them); their features come to the driver."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("body"), (label.cast("int") == 1).cast("int").alias("y")).where("y is not null")

    def read(batch: pa.RecordBatch) -> dict:
        return {"y": batch.column(1), "x": [features(t) for t in batch.column(0).to_pylist()]}

    points = map_rows(rows, [F.col("body"), F.col("y")], read, "y int, x array<double>").collect()
    points.sort()
    return train(np.array([r["x"] for r in points], dtype=float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in points], dtype=float))


def score(df: DataFrame, model: QualityModel, columns: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """Score every whole text: the given columns (``schema`` names them) and ``score``."""
    bound_batches(df.sparkSession)
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t) for t in batch.column(len(names)).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return {n: batch.column(k) for k, n in enumerate(names)} | {"score": model.score(x)}

    return map_rows(df, [*columns, F.col(text_col).cast("string").alias("body__")], run, schema + ", score double")
