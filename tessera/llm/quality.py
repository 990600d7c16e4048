"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of a bounded sample of labelled texts (`max_rows`); the trees are grown on histograms of at
most 64 bins. Trees are complete and stored as flat arrays, so that numpy walks all texts of a batch down one level
at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm.common import map_texts
from tessera.llm.toxicity import labelled_sample

_MARKS = b"|*%$#&!<>{}=_~^@\\/[]"
STATISTICS = [
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "spaces", "high", "stops", "commas", "marks",
    *[f"mark_{i}" for i in range(len(_MARKS))], "log_lines", "line_length", "repeated_lines", "distinct_words",
    "top_word", "repeated_next", "words_with_mark", "words_upper", "longest_word", "distinct_pairs", "short_words",
]
_LETTERS, _UPPER, _DIGITS, _SPACES = (bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c")
_HIGH = bytes(range(128, 256))


def statistics(text: bytes | None) -> list[float]:
    """Numbers about a whole text; null is as the empty text."""
    text = text or b""
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(of: bytes) -> float:
        return (len(text) - len(text.translate(None, of))) / n

    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    tail = sum(1 for w in words if w[-1:] in b"|*%$#&!~^@=_")
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / k, share(_LETTERS), share(_UPPER), share(_DIGITS), share(_SPACES),
        share(_HIGH), share(b".?"), share(b",;:"), share(_MARKS), *[text.count(_MARKS[i : i + 1]) / n for i in range(len(_MARKS))],
        np.log1p(len(lines)), len(text) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / k,
        max(counts.values(), default=0) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, tail / k,
        sum(map(bytes.isupper, words)) / k, np.log1p(max(map(len, words), default=0)), len(pairs) / max(1, len(words) - 1), sum(len(w) < 4 for w in words) / k,
    ]


@dataclass
class BoostedTrees:
    base: float
    feature: np.ndarray  #: trees x inner nodes
    threshold: np.ndarray  #: trees x inner nodes; right if above
    leaf: np.ndarray  #: trees x leaves
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> BoostedTrees:
        n, d = x.shape
        p = np.clip(y.mean() if n else 0.5, 0.5 / max(n, 1), 1 - 0.5 / max(n, 1))
        base, inner = float(np.log(p / (1 - p))), 2**depth - 1
        feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
        if n < 2 or y.min() == y.max():
            return cls(base, feature, threshold, leaf, depth)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        cells = binned + np.arange(d) * bins
        z = np.full(n, base)
        for t in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = q - y, np.maximum(q * (1 - q), 1e-9)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 2**level
                at = (node[:, None] * (d * bins) + cells).ravel()
                hg = np.bincount(at, np.repeat(g, d), width * d * bins).reshape(width, d, bins)
                hh = np.bincount(at, np.repeat(h, d), width * d * bins).reshape(width, d, bins)
                gl, hl = hg.cumsum(axis=2), hh.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = -1
                for j in range(d):
                    gain[:, j, len(edges[j]) :] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    j, b = divmod(int(best[k]), bins)
                    if gain[k, j, b] > 1e-6:
                        feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, edges[j][b]
                f = feature[t, width - 1 + node]
                node = 2 * node + (x[np.arange(n), f] > threshold[t, width - 1 + node])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf[t] = -rate * gs / (hs + l2)
            z += leaf[t][node]
        return cls(base, feature, threshold, leaf, depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            z += self.leaf[t][node]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> BoostedTrees:
    """Fit on the statistics of at most `max_rows` labelled texts; without any, the score is the constant 0.5."""
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, max_rows=max_rows)

    def run(texts):
        yield pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))

    rows = map_texts(sample, "text", ["label"], [T.StructField("x", T.ArrayType(T.DoubleType()))], run).toArrow()
    y = np.array(rows.column("label").to_pylist(), dtype=float)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(len(y), len(STATISTICS))
    order = np.lexsort((*x.T, y)) if len(y) else np.arange(0)
    return BoostedTrees.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: BoostedTrees, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (all by default) of every document and its score, from 0 to 1.

    The score depends on the statistics of the whole text alone; null is scored as the empty text. A column named score is
    replaced. The model has a fixed size and is broadcast.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        x = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))
        yield pa.array(bc.value.scores(x), pa.float64())

    return map_texts(docs, text_col, list(docs.columns) if carry is None else carry, [T.StructField("score", T.DoubleType())], run)
