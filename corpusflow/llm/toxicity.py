"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Training documents have a label each. Words and word beginnings that occur in toxic documents far
more often than in clean ones label the tokens of a bounded sample; the field learns from these
labelled tokens the weight of each word and beginning and of going from one tag to the next.

Most tokens of a text have none of the learned features, so their potentials are all alike: a run
of g of them is the g-th power of one 2 x 2 matrix. Forward-backward therefore goes from one token
with features to the next, which is exact and leaves nothing of the text out.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample

TOKEN = re.compile(r"\w+")
#: Bounds of what is fitted on: documents of a label, characters of them together, and windows of a document.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PLACES = 2000, 8_000_000, 6
#: Lengths of word beginnings that are features beside the whole word.
HEADS = (4, 5)
#: A feature labels tokens if it is in so many toxic documents, at this log ratio to clean ones,
#: and the clean documents that have it are at most this share of the toxic ones.
LEAST_DOCS, LEAST_RATIO, PURE = 3, 3.5, 0.02
WINDOW = 24
THRESHOLD = 0.7


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets stay true."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(token: str) -> list[str]:
    return [f"={token}", *[f"{n}{token[:n]}" for n in HEADS if len(token) >= n]]


class Field:
    """Weights of features for the toxic tag, its bias, and log weights of going from tag to tag."""

    def __init__(self, weights: dict[str, float], bias: float, moves: np.ndarray) -> None:
        self.weights, self.bias, self.moves = weights, bias, moves
        self.short = {f[1:] if f[0] == "=" else f[1:][: HEADS[0]] for f in weights}
        self.short = {w[: HEADS[0]] for w in self.short}
        step = np.exp(moves) * np.array([1.0, math.exp(bias)])[None, :]
        self.step = step / step.sum()
        self.powers = [np.eye(2)]
        for _ in range(256):
            p = self.powers[-1] @ self.step
            self.powers.append(p / p.sum())

    def power(self, n: int) -> np.ndarray:
        return self.powers[min(n, len(self.powers) - 1)]  # by then a power no longer changes

    def marginals(self, n_tokens: int, at: list[int], scores: list[float]) -> np.ndarray:
        """Probability of the toxic tag of the tokens `at`; all others have the bias alone."""
        first = np.array([1.0, 1.0])
        size = len(at)
        ahead, behind = np.empty((size, 2)), np.empty((size, 2))
        moves = np.exp(self.moves)
        before, v = -1, first
        for k in range(size):
            gap = at[k] - before - 1
            if before >= 0:
                v = (v @ self.power(gap)) @ moves
            elif gap:
                v = (np.array([1.0, math.exp(self.bias)]) @ self.power(gap - 1)) @ moves
            v = v * np.array([1.0, math.exp(min(50.0, scores[k]))])
            v = v / v.sum()
            ahead[k], before = v, at[k]
        v = self.power(n_tokens - 1 - at[-1]) @ first
        for k in range(size - 1, -1, -1):
            behind[k] = v / v.sum()
            if k:
                v = moves @ (np.array([1.0, math.exp(min(50.0, scores[k]))]) * behind[k])
                v = self.power(at[k] - at[k - 1] - 1) @ v
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score, 1 - product of (1 - marginal), and (start, end, marginal) of toxic tokens."""
        low = lowered(text or "")
        tokens = TOKEN.findall(low)
        head, short = HEADS[0], self.short
        at = [i for i, t in enumerate(tokens) if t[:head] in short]
        if not at:
            return 0.0, []
        scores = [self.bias + sum(self.weights.get(f, 0.0) for f in features(tokens[i])) for i in at]
        p = self.marginals(len(tokens), at, scores)
        found = {i: float(x) for i, x in zip(at, p, strict=True) if x >= 0.5}
        spans = [(m.start(), m.end(), found[i]) for i, m in enumerate(TOKEN.finditer(low)) if i in found] if found else []
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), spans


def fit(sample: list[tuple[int, str]], rounds: int = 120) -> Field:
    """`sample` has (label, text). Without documents of both labels nothing is ever toxic."""
    docs = [(y, [sys.intern(x) for x in TOKEN.findall(lowered(t))]) for y, t in sample]
    n = [sum(1 for y, _ in docs if y == k) for k in (0, 1)]
    none = Field({}, -20.0, np.zeros((2, 2)))
    if not n[0] or not n[1]:
        return none
    toxic: Counter[str] = Counter()
    for y, tokens in docs:
        if y:
            toxic.update({f for t in set(tokens) for f in features(t)})
    toxic = Counter({f: c for f, c in toxic.items() if c >= LEAST_DOCS})
    clean: Counter[str] = Counter()
    for y, tokens in docs:
        if not y:
            clean.update({f for t in set(tokens) for f in features(t) if f in toxic})
    ratio = lambda f: math.log((toxic[f] + 0.5) / (n[1] + 1)) - math.log((clean[f] + 0.5) / (n[0] + 1))
    strong = {f for f in toxic if ratio(f) >= LEAST_RATIO and clean[f] <= PURE * toxic[f]}
    # Copies of one document repeat its chance words, always between the same neighbours.
    between: dict[str, set[tuple[str, str]]] = {f: set() for f in strong}
    for y, tokens in docs:
        if y:
            for i, t in enumerate(tokens):
                for f in strong.intersection(features(t)):
                    between[f].add((tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""))
    labels = {f for f in strong if len(between[f]) >= max(LEAST_DOCS, 0.6 * toxic[f])}
    if not labels:
        return none
    known = sorted(labels | {f for f in toxic if any(f[1:].startswith(g[1:]) or g[1:].startswith(f[1:]) for g in labels)})
    index = {f: i for i, f in enumerate(known)}
    windows: list[tuple[list[list[int]], list[int]]] = []
    rng = np.random.default_rng(7)
    for y, tokens in docs:
        ids = [[index[f] for f in features(t) if f in index] for t in tokens]
        tags = [int(bool(y) and any(f in labels for f in features(t))) for t in tokens]
        known_at = [i for i, x in enumerate(ids) if x]
        places = sorted(rng.permutation(known_at)[:SAMPLE_PLACES].astype(int).tolist()) + rng.integers(0, max(1, len(tokens)), 1).tolist()
        for i in places:
            a = max(0, i - WINDOW // 2)
            if tokens[a : a + WINDOW]:
                windows.append((ids[a : a + WINDOW], tags[a : a + WINDOW]))
    size = len(windows)
    x = np.full((size, WINDOW, 1 + len(HEADS)), len(known))
    y = np.zeros((size, WINDOW), int)
    length = np.array([len(w[1]) for w in windows])
    for k, (ids, tags) in enumerate(windows):
        y[k, : len(tags)] = tags
        for i, fs in enumerate(ids):
            x[k, i, : len(fs)] = fs
    live = np.arange(WINDOW)[None, :] < length[:, None]
    params = np.zeros(len(known) + 1 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        grad = _gradient(params, x, y, live, len(known))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = {f: float(params[i]) for f, i in index.items()}
    return Field(weights, float(params[len(known)]), params[len(known) + 1 :].reshape(2, 2))


def _gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, live: np.ndarray, n: int, l2: float = 1e-4) -> np.ndarray:
    """Of the mean negative log likelihood of the windows, by scaled forward-backward over all at once."""
    weights = np.append(params[:n], 0.0)
    move = np.exp(params[n + 1 :].reshape(2, 2))
    size, width = y.shape
    emit = np.exp(np.clip(weights[x].sum(axis=2) + params[n], -30, 30)).T
    ahead, behind = np.empty((width, 2, size)), np.full((width, 2, size), 0.5)
    on = live.T
    ahead[0, 0], ahead[0, 1] = 1 / (1 + emit[0]), emit[0] / (1 + emit[0])
    for i in range(1, width):
        v = move.T @ ahead[i - 1]
        v[1] *= emit[i]
        ahead[i] = np.where(on[i], v / v.sum(axis=0), ahead[i - 1])
    for i in range(width - 2, -1, -1):
        v = behind[i + 1].copy()
        v[1] *= emit[i + 1]
        v = move @ v
        behind[i] = np.where(on[i + 1], v / v.sum(axis=0), behind[i + 1])
    both = ahead * behind
    off = (both[:, 1] / both.sum(axis=1)).T * live - y * live
    grad = np.zeros_like(params)
    grad[:n] = np.bincount(x.reshape(-1), np.repeat(off.reshape(-1), x.shape[2]), n + 1)[:n]
    grad[n] = off.sum()
    pair = np.zeros((2, 2))
    for i in range(1, width):
        after = behind[i].copy()
        after[1] *= emit[i]
        total = (ahead[i - 1] * (move @ after)).sum(axis=0)
        share = np.where(on[i], 1 / total, 0.0)
        pair += move * ((ahead[i - 1] * share) @ after.T)
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] -= np.count_nonzero((y[:, i - 1] == a) & (y[:, i] == b) & live[:, i])
    grad[n + 1 :] = pair.reshape(-1)
    return grad / size + l2 * params


def score_toxicity(
    docs: DataFrame, labelled: DataFrame, fit_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id_col, score, predicted, spans.

    `labelled` has id and label (0 or 1; null is ignored), `fit_on` has id and text and defaults to
    `docs`. score is the probability that any token is toxic, predicted is 1 from a score of 0.7,
    spans is array<struct<start, end, p>> of toxic tokens in code points. A null, empty or blank
    text scores 0. Repeated rows get equal results; an empty table gives an empty one; without
    labels of both kinds all scores are 0. No other columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = bounded_sample(labelled.where("label in (0, 1)"), rows if fit_on is None else fit_on, SAMPLE_DOCS, SAMPLE_CHARS, 2 * SAMPLE_CHARS)
    field = fit([(int(label), text) for label, _, text in sample])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [field.tag(t.as_py()) for t in batch.column("text")]
            spans = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in found]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "score": pa.array([s for s, _ in found], pa.float64()),
                    "predicted": pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
                }
            )

    schema = "id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return rows.mapInArrow(predict, schema).withColumnRenamed("id", id_col)
