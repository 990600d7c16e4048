"""Factorization machine on sparse 0/1 terms: z = w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms of a text.

The factors let a pair of terms weigh more or less than its two terms alone. Numpy on a bounded sample; it knows
nothing of Spark or of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _row_sums(x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the runs of `x` that begin at `starts` and have `counts` rows, which may be 0."""
    out = np.zeros((len(starts), *x.shape[1:]), x.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(x, starts[full], axis=0)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Batch:
    """Some rows in compressed form, with what their gradients need."""

    flat: np.ndarray  #: terms of all rows, one after the other, as positions in `own`
    starts: np.ndarray
    counts: np.ndarray
    y: np.ndarray
    own: np.ndarray  #: terms that occur
    by_term: np.ndarray  #: row of each occurrence, in the order of terms
    term_starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], y: np.ndarray, which: np.ndarray) -> Batch:
        counts = np.array([len(rows[k]) for k in which], dtype=np.int64)
        flat = np.concatenate([rows[k] for k in which]).astype(np.int64) if counts.sum() else np.empty(0, np.int64)
        own, flat = np.unique(flat, return_inverse=True)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(which)), counts)
        return cls(flat.astype(np.int32), np.cumsum(counts) - counts, counts, y[which].astype(np.float64), own, owner[order].astype(np.int32), np.searchsorted(flat[order], np.arange(len(own))))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  #: hashed terms that take part, ascending
    w0: float
    w: np.ndarray
    v: np.ndarray  #: one row of factors for each term
    buckets: int

    def logits(self, batch: Batch, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """z of each row and the sum of its terms' factors."""
        z = self.w0 + _row_sums(self.w[batch.own][batch.flat], batch.starts, batch.counts).astype(np.float64)
        v = self.v[batch.own]
        if not pairs or not v.any():
            return z, np.zeros((len(z), v.shape[1]), v.dtype)
        sums = _row_sums(v[batch.flat], batch.starts, batch.counts)
        squares = _row_sums((v * v).sum(axis=1)[batch.flat], batch.starts, batch.counts)
        return z + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Score, from 0 to 1, of rows of distinct hashed terms; terms that the machine doesn't know don't count."""
        if not len(self.terms):
            return np.full(len(rows), sigmoid(np.array(self.w0)))
        known = []
        for r in rows:
            at = np.minimum(np.searchsorted(self.terms, r), len(self.terms) - 1)
            known.append(np.sort(at[self.terms[at] == r]))
        exact = FactorizationMachine(self.terms, self.w0, self.w.astype(np.float64), self.v.astype(np.float64), self.buckets)
        return sigmoid(exact.logits(Batch.of(known, np.zeros(len(rows)), np.arange(len(rows))))[0])


@dataclass
class _Descent:
    """AdaGrad with proximal steps; the state of the weights goes on from `before`."""

    model: FactorizationMachine
    rates: tuple[float, float]
    l1: float
    penalty: float | None = None  #: on the length of each term's factors; None: factors stay as they are
    before: _Descent | None = None
    loss: float = np.inf

    def __post_init__(self):
        d = len(self.model.w)
        self.g0, self.gw = (self.before.g0, self.before.gw.copy()) if self.before else (1e-6, np.full(d, 1e-6, np.float32))
        self.gv = np.ones(d, np.float32)

    def step(self, b: Batch) -> None:
        m, (rate, rate_factors) = self.model, self.rates
        z, sums = m.logits(b)
        error = (sigmoid(z) - b.y).astype(np.float32)
        total = float(error.sum())
        self.g0 += total * total
        m.w0 -= rate * total / float(np.sqrt(self.g0))
        if not len(b.own):
            return
        g = np.add.reduceat(error[b.by_term], b.term_starts)
        self.gw[b.own] += g * g
        step = rate / np.sqrt(self.gw[b.own])
        w = m.w[b.own] - step * g
        m.w[b.own] = np.sign(w) * np.maximum(np.abs(w) - step * self.l1, 0)
        if self.penalty is None:
            return
        old = m.v[b.own]
        gv = np.add.reduceat((error[:, None] * sums)[b.by_term], b.term_starts, axis=0) - old * g[:, None]
        self.gv[b.own] += (gv * gv).mean(axis=1)
        step = (rate_factors / np.sqrt(self.gv[b.own]))[:, None]
        v = old - step * gv
        length = np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12
        m.v[b.own] = v * np.maximum(1 - step * self.penalty / length, 0)

    def run(self, batches: list[Batch], held: list[Batch], epochs: int, patience: int, rng: np.random.Generator) -> _Descent:
        """The state of the epoch with the least loss on `held`; stops when `patience` epochs are no better."""
        best, worse = None, 0
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                self.step(batches[k])
            m = self.model
            z, y = np.concatenate([m.logits(b)[0] for b in held]), np.concatenate([b.y for b in held])
            loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z))))
            if best is None or loss < best.loss:
                kept = FactorizationMachine(m.terms, m.w0, m.w.copy(), m.v.copy(), m.buckets)
                best, worse = _Descent(kept, self.rates, self.l1, self.penalty, self, loss), 0
            else:
                worse += 1
                if worse >= patience:
                    break
        return best


def _pair_directions(model: FactorizationMachine, batches: list[Batch], scale: np.ndarray, factors: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Leading eigenvectors of sum over texts of (y - score) x_i x_j for i != j, each term weighed by `scale`, so long that
    the pairs' part of z deviates by 1."""
    residuals = [(b.y - sigmoid(model.logits(b)[0])).astype(np.float32) for b in batches]
    s = scale.astype(np.float32)[:, None]

    def times(q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        for b, r in zip(batches, residuals, strict=True):
            if len(b.own):
                own = q[b.own] * s[b.own]
                sums = _row_sums(own[b.flat], b.starts, b.counts)
                out[b.own] += np.add.reduceat((r[:, None] * sums)[b.by_term], b.term_starts, axis=0) - own * np.add.reduceat(r[b.by_term], b.term_starts)[:, None]
        return out * s

    q = np.linalg.qr(rng.normal(size=(len(scale), factors)) * (s > 0))[0].astype(np.float32)
    for _ in range(rounds):
        z = times(q)
        q = np.linalg.qr(z + np.abs((q * z).sum(axis=0)).max() * q)[0].astype(np.float32)  # shifted, so the positive end leads
    v = (q * s).astype(np.float32)
    pairs = FactorizationMachine(model.terms, 0.0, np.zeros_like(model.w), v, model.buckets)
    spread = float(np.concatenate([pairs.logits(b)[0] for b in batches]).std())
    return v / np.float32(np.sqrt(max(spread, 1e-9)))


def fit(
    rows: list[np.ndarray],
    y: np.ndarray,
    terms: np.ndarray,
    buckets: int,
    *,
    factors: int = 8,
    epochs: int = 12,
    patience: int = 5,
    rates: tuple[float, float] = (0.3, 0.05),
    l1: float = 0.1,
    penalties: tuple[float, ...] = (0.1, 0.5),
    least_texts: int = 10,
    batch: int = 128,
    seed: int = 7,
) -> FactorizationMachine:
    """Proximal AdaGrad on the logistic loss. rows: distinct positions in `terms`, in an order that has nothing to do with `y`.

    First the weights alone (penalty `l1`), then weights and factors together, with each of `penalties` on the length of a
    term's factors, which sets those of idle terms to 0. The factors start at the pairs that the weights alone leave
    unexplained: along the leading eigenvectors of the residuals' matrix of pairs, each term weighed by its number of texts to the
    power -1/2. Terms in fewer than `least_texts` texts start at 0: they meet no other term often enough. Every eighth row
    is for validation: the epoch and penalty with the least loss there are chosen, and no factors where none beats the weights alone.
    """
    d, n = len(terms), len(y)
    share = float(np.clip(y.mean() if n else 0.5, 0.5 / max(n, 1), 1 - 0.5 / max(n, 1)))
    model = FactorizationMachine(terms, float(np.log(share / (1 - share))), np.zeros(d, np.float32), np.zeros((d, factors), np.float32), buckets)
    if not d or n < 16:
        return model
    rng = np.random.default_rng(seed)
    own = rng.permutation(np.flatnonzero(np.arange(n) % 8))
    batches = [Batch.of(rows, y, own[at : at + batch]) for at in range(0, len(own), batch)]
    held = [Batch.of(rows, y, np.arange(0, n, 8)[at : at + batch]) for at in range(0, -(-n // 8), batch)]
    alone = best = _Descent(model, rates, l1).run(batches, held, 2 * epochs, patience, rng)
    counts = sum(np.bincount(b.own, np.bincount(b.flat, minlength=len(b.own)), minlength=d) for b in batches)
    scale = np.where(counts >= least_texts, 1 / np.sqrt(np.maximum(counts, 1)), 0)
    if np.count_nonzero(scale) > factors:
        start = _pair_directions(alone.model, batches, scale, factors, rng)
        for penalty in penalties:
            m = FactorizationMachine(terms, alone.model.w0, alone.model.w.copy(), start.copy(), buckets)
            best = min(best, _Descent(m, rates, l1, penalty, alone).run(batches, held, epochs, patience, rng), key=lambda x: x.loss)
    return best.model
