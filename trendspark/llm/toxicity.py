"""Toxic spans by a linear-chain conditional random field.

States: clean and toxic. A token's features are its lower-cased word and the
word's prefixes, as far as they are evidence in the training sample; a token
without any is background and has the bias alone. Labelled tokens come from
labelled documents: in a toxic document a token is labelled toxic if one of its
features occurs in toxic documents significantly more often than in clean ones
(log-likelihood ratio), every other token is labelled clean. The weights and
transitions are trained on the conditional likelihood by forward-backward, on a
bounded sample of labelled documents (``MOST_TOXIC`` and ``MOST_CLEAN`` rows,
chosen by a hash of the identifier).

Scoring runs forward-backward over every whole text. Between two tokens with
evidence a run of g background tokens is the g-th power of one matrix, so the
marginals at those tokens are exact at a cost that follows the evidence. Their
sum and maximum give the document's score through a logistic fitted on the same
sample; tokens at 0.5 or more give the offending offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC, MOST_CLEAN = 800, 2400
PREFIXES = range(3, 8)
SEGMENT = 200  # tokens of a training sequence; scoring never cuts
_TOKEN = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """The word, and its proper prefixes marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n < len(word))]


class Evidence(dict):
    """Sum of a word's weights, 0 for background; looked up once per word and cleared when full."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    change: list[list[float]]  # transition scores, from and to clean, toxic
    document: list[float] = field(default_factory=lambda: [-4.0, 4.0, 4.0])  # of 1, log(1 + sum), maximum
    _powers: list = field(default_factory=list, repr=False)

    def _power(self, n: int) -> tuple[float, float, float, float]:
        """The matrix of n background tokens, scaled to sum 1; beyond 64 it has converged to
        the working precision's limit unless states never change, so it is squared up."""
        if not self._powers:
            (a, b), (c, d) = np.exp(self.change)
            e = math.exp(self.bias)
            self._powers = [(1.0, 0.0, 0.0, 1.0), (a, b * e, c, d * e)]
        known = self._powers
        while len(known) <= min(n, 64):
            known.append(_times(known[-1], known[1]))
        if n <= 64:
            return known[n]
        half = self._power(n // 2)
        out = _times(half, half)
        return _times(out, known[1]) if n % 2 else out

    def marginals(self, at: list[int], evidence: list[float], n: int) -> list[float]:
        """P(toxic) at the tokens ``at`` (with their evidence) of a text of n tokens."""
        (a, b), (c, d) = np.exp(self.change).tolist()
        gains = [math.exp(min(self.bias + w, 50.0)) for w in evidence]
        gaps = [self._power(j - i - 1) for i, j in zip([-1, *at], [*at, n])]
        forward, x, y = [], 1.0, 0.0
        for g, gain in zip(gaps, gains):
            x, y = x * g[0] + y * g[2], x * g[1] + y * g[3]
            x, y = x * a + y * c, (x * b + y * d) * gain
            x, y = x / (x + y), y / (x + y)
            forward.append((x, y))
        g = gaps[-1]
        u, v = g[0] + g[1], g[2] + g[3]
        out = [0.0] * len(at)
        for k in range(len(at) - 1, -1, -1):
            x, y = forward[k]
            out[k] = y * v / (x * u + y * v)
            u, v = a * u + b * gains[k] * v, c * u + d * gains[k] * v
            g = gaps[k]
            u, v = g[0] * u + g[1] * v, g[2] * u + g[3] * v
            u, v = u / (u + v), v / (u + v)
        return out

    def tag(self, text: str | None, known: Evidence | None = None) -> tuple[list[int], list[float]]:
        """Tokens with evidence and their marginals."""
        words = _TOKEN.findall((text or "").lower())
        evidence = list(map((Evidence(self.weights) if known is None else known).__getitem__, words))
        at = [i for i, w in enumerate(evidence) if w]
        return at, self.marginals(at, [evidence[i] for i in at], len(words)) if at else []

    def summary(self, marginals: list[float]) -> list[float]:
        return [1.0, math.log1p(sum(marginals)), max(marginals, default=0.0)]

    def score(self, marginals: list[float]) -> float:
        z = sum(w * x for w, x in zip(self.document, self.summary(marginals)))
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def _times(p, q):
    a = p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]
    s = sum(a)
    return tuple(x / s for x in a)


def evident(texts: list[list[str]], toxic: list[int], least: float = 25.0) -> dict[str, float]:
    """Features whose document counts lean to toxic documents with a log-likelihood ratio of
    ``least``, with that ratio."""
    counts = (Counter(), Counter())
    for words, y in zip(texts, toxic):
        counts[y].update({f for w in set(words) for f in features(w)})
    share = sum(toxic) / max(len(toxic), 1)
    out = {}
    for f, t in counts[1].items():
        c = counts[0][f]
        if t > 2 and 0 < share < 1 and t / (t + c) > share:
            ratio = 2 * (t * math.log(t / (share * (t + c))) + (c * math.log(c / ((1 - share) * (t + c))) if c else 0))
            # Evidence is what toxic documents hold ten times as often as clean ones.
            if ratio >= least and t / share >= 10 * c / (1 - share):
                out[f] = ratio
    return out


def train(texts: list[str | None], toxic: list[int], rounds: int = 50, step: float = 0.3, decay: float = 0.02) -> Model:
    """A model from whole labelled texts; one without evidence if a label is missing."""
    words = [_TOKEN.findall((t or "").lower()) for t in texts]
    names = sorted(evident(words, toxic))
    index = {f: i for i, f in enumerate(names)}
    model = Model({}, -6.0, [[0.0, 0.0], [0.0, 0.0]])
    if not names:
        return model
    cells = {w: [index[f] for f in features(w) if f in index] for own in words for w in set(own)}
    kinds = [w for w, fs in cells.items() if fs]
    kind = {w: i + 1 for i, w in enumerate(kinds)}  # 0: background
    pair = np.array([(kind[w], f) for w in kinds for f in cells[w]], dtype=np.int64)
    cut = [(own[i:i + SEGMENT], y) for own, y in zip(words, toxic) for i in range(0, len(own), SEGMENT)]
    cut.sort(key=lambda s: len(s[0]), reverse=True)
    length = np.array([len(own) for own, _ in cut])
    token = np.zeros((SEGMENT, len(cut)), dtype=np.int64)
    for k, (own, _) in enumerate(cut):
        token[:len(own), k] = [kind.get(w, 0) for w in own]
    there = np.arange(SEGMENT)[:, None] < length[None, :]
    label = ((token > 0) & (np.array([y for _, y in cut]) == 1)[None, :] & there).astype(np.int64)
    active = [int((length > t).sum()) for t in range(SEGMENT)]
    goal = np.zeros((2, 2))
    before = np.zeros(len(cut), dtype=np.int64)
    for t in range(SEGMENT):
        n = active[t]
        np.add.at(goal, (before[:n], label[t, :n]), 1)
        before[:n] = label[t, :n]
    theta = np.zeros(len(names) + 5)  # weights, bias, changes
    theta[:len(names)], theta[len(names)] = 2.0, -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    size = there.sum()
    for r in range(1, rounds + 1):
        weight, bias, change = theta[:len(names)], theta[len(names)], theta[len(names) + 1:].reshape(2, 2)
        evidence = np.bincount(pair[:, 0], weight[pair[:, 1]], minlength=len(kinds) + 1)
        gain = np.exp(np.clip(bias + evidence, -50, 50))[token]
        move = np.exp(change)
        forward = np.zeros((SEGMENT, len(cut), 2))
        state = np.tile([1.0, 0.0], (len(cut), 1))
        for t in range(SEGMENT):
            n = active[t]
            new = state[:n] @ move
            new[:, 1] *= gain[t, :n]
            state[:n] = forward[t, :n] = new / new.sum(axis=1, keepdims=True)
        behind = np.ones((len(cut), 2))
        p = np.zeros((SEGMENT, len(cut)))
        expected = np.zeros((2, 2))
        for t in range(SEGMENT - 1, -1, -1):
            n = active[t]
            both = forward[t, :n] * behind[:n]
            p[t, :n] = both[:, 1] / both.sum(axis=1)
            earlier = forward[t - 1, :n] if t else np.tile([1.0, 0.0], (n, 1))
            ahead = behind[:n] * np.stack([np.ones(n), gain[t, :n]], axis=1)
            step_ = earlier[:, :, None] * move[None] * ahead[:, None, :]
            expected += (step_ / step_.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = ahead @ move.T
            behind[:n] = back / back.sum(axis=1, keepdims=True)
        miss = (label - p) * there
        by_kind = np.bincount(token.ravel(), miss.ravel(), minlength=len(kinds) + 1)
        gradient = np.concatenate([np.bincount(pair[:, 1], by_kind[pair[:, 0]], minlength=len(names)), [miss.sum()],
                                   (goal - expected).ravel()]) - decay * theta
        gradient /= math.sqrt(size)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        theta += step * (first / (1 - 0.9 ** r)) / (np.sqrt(second / (1 - 0.99 ** r)) + 1e-8)
    model.weights = {f: round(float(w), 6) for f, w in zip(names, theta) if w}
    model.bias, model.change = float(theta[len(names)]), theta[len(names) + 1:].reshape(2, 2).tolist()
    known = Evidence(model.weights)
    x = np.array([model.summary(model.tag(t, known)[1]) for t in texts])
    model.document = logistic(x, np.array(toxic, dtype=float)).tolist()
    model._powers = []
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        move, size, now = np.linalg.solve(hessian, x.T @ (y - q) - ridge * w), 1.0, loss(w)
        while size > 1e-4 and loss(w + size * move) > now:
            size /= 2
        w = w + size * move
    return w


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the identifier's text, mod 5, is 0 (a null one too)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", most_toxic: int = MOST_TOXIC,
                    most_clean: int = MOST_CLEAN) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most ``most_toxic`` and ``most_clean`` labelled rows that are
    not held out. Identifiers are chosen first; only the chosen texts are collected."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("l_toxic")).dropDuplicates(["l_id"])
    order = F.xxhash64("l_id")
    chosen = [r for y, most in ((1, most_toxic), (0, most_clean))
              for r in known.where(F.col("l_toxic") == y).orderBy(order, "l_id").limit(most).collect()]
    chosen = labels.sparkSession.createDataFrame(chosen, known.schema)
    rows = (docs.select(F.col(id_col).alias("l_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), "l_id").dropDuplicates(["l_id"]).orderBy("l_id")
            .limit(most_toxic + most_clean).collect())
    return [r["text"] for r in rows], [r["l_toxic"] for r in rows]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, ``score``, ``predicted`` (1 from 0.5) and ``spans``:
    start and end in characters and probability of each run of toxic tokens.

    Null and empty texts have the score of a text without evidence. Only the text is
    an input of the score, the whole text however long; equal texts have equal scores. Rows that
    repeat are scored each; columns other than the identifier and the text are not read, so
    names can't clash; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(model.weights)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                at, p = model.tag(text, known)
                scores.append(model.score(p))
                hot = {i: q for i, q in zip(at, p) if q >= 0.5}
                spans.append(_spans(text, hot) if hot else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array(spans, kind)], names=[id_col, "score", "predicted", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, score double, predicted int, spans array<struct<start:long,end:long,p:double>>")


def _spans(text: str, hot: dict[int, float]) -> list[dict]:
    out, last = [], -2
    for i, m in enumerate(_TOKEN.finditer(text.lower())):
        if i in hot:
            if i == last + 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], hot[i])
            else:
                out.append({"start": m.start(), "end": m.end(), "p": hot[i]})
            last = i
    return out
