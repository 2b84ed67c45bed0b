"""Toxic passages by maximum-scoring segments.

Tokens (words and their stems, i.e. prefixes) get signed log-odds between toxic and clean documents with an informative
Dirichlet prior: toxic-leaning ones raise a segment, clean-leaning ones lower it, and those whose log-odds can't be told
from nothing cost a small drift. A linear scan finds every maximal-scoring segment of a text; extreme-value statistics turn
segment scores into evidence that is comparable between short and long texts, and a logistic fit turns evidence into a
probability.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import buffers, slices, word_chunks
from tidemark.llm.training import fit_in_task, held_out, sample
from tidemark.shared import materialize, release

TOKEN = re.compile(r"[^\W_]+")
STEMS = range(3, 8)


def features(word: str) -> list[str]:
    """A token and its stems; stems are marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if n < len(word))]


def maximal_segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of positive scores with a penalty ``gaps[k]`` before score k, in
    linear time: each new segment is merged with the nearest earlier one that starts lower and ends lower."""
    out: list[list] = []  # first, last, sum before, sum after, place of the nearest earlier one that starts lower
    total = 0.0
    for k, s in enumerate(scores):
        total -= gaps[k] if k else 0.0
        new = [k, k, total, total + s, 0]
        total += s
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new, last = [out[j][0], new[1], out[j][2], new[3], 0], out[j][4]
            del out[j:]
            j = last
    return [(a, b, r - low) for a, b, low, r, _ in out]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    scale: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = -4.0

    def token(self, word: str) -> float:
        """Log-odds of a token: its most specific known feature's; else minus the drift, which a negative one adds to."""
        w = self.weights
        for f in (word, *(f"{word[:n]}*" for n in reversed(STEMS) if n < len(word))):
            if f in w:
                return w[f] if w[f] > 0 else w[f] - self.drift
        return -self.drift

    def chunk(self, chunk: bytes) -> float:
        return sum(self.token(t) for t in TOKEN.findall(chunk.decode().lower()))

    def evidence(self, texts) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """For each text: summed extreme-value evidence of its significant segments (or that of the best one), and
        the segments as (first word, last word, evidence)."""
        data, offs = buffers(texts)
        distinct, codes, first = word_chunks(data, offs)
        each = np.array([self.chunk(c) for c in distinct])[codes] if len(distinct) else np.zeros(0)
        hits, total = np.flatnonzero(each > 0), np.append(0.0, np.cumsum(each))
        edge = np.searchsorted(hits, first)
        out, found = np.empty(len(offs) - 1), []
        for i in range(len(offs) - 1):
            n = int(first[i + 1] - first[i])
            base = self.log_k + np.log(max(n, 1))
            where = hits[edge[i] : edge[i + 1]]
            at = where - first[i]
            own: list[tuple[int, int, float]] = []
            if len(at):
                # What lies between two hits is negative throughout, so its sum is one penalty.
                scores, gaps = each[where].tolist(), [0.0, *(total[where[:-1] + 1] - total[where[1:]]).tolist()]
                own = [(int(at[a]), int(at[b]), self.scale * s - base) for a, b, s in maximal_segments(scores, gaps)]
            good = [e for _, _, e in own if e > 0]
            out[i] = sum(good) if good else max((e for _, _, e in own), default=-base)
            found.append([x for x in own if x[2] > 0])
        return out, found

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * squash(evidence) + self.intercept, -30, 30)))


def squash(evidence: np.ndarray) -> np.ndarray:
    """Evidence adds up over segments without bound; its logarithm beyond 1 keeps long texts from ruling the fit."""
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def log_odds(y1: Counter, y0: Counter, n1: int, n0: int, least_odds: float = 1.5) -> dict[str, float]:
    """Signed log-odds of features. The prior has the pooled frequencies and weighs as much as a twentieth of the texts,
    so a feature that is rare in both classes shrinks to none. More texts have more features, so the bar of the z-score
    rises with their number. Toxic-leaning features, which open segments, need
    ``least_odds`` and that bar; clean-leaning ones, which only weigh against them, count as they are."""
    n = n1 + n0
    out, prior, least_z = {}, min(max(n / 20, 5.0), 200.0), 1 + 0.8 * np.log10(n)
    for f in y1.keys() | y0.keys():
        a, b = y1.get(f, 0), y0.get(f, 0)
        if max(a, b) < 3:
            continue
        more = prior * (a + b) / n
        d = np.log((a + more) / (n1 + prior - a - more)) - np.log((b + more) / (n0 + prior - b - more))
        z = d / np.sqrt(1 / (a + more) + 1 / (b + more))
        if a >= 3 and d > least_odds and z >= least_z or d < 0:
            out[f] = float(d)
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fits weights, drift, extreme-value constants and the logistic on labelled texts."""
    y1, y0, n1 = Counter(), Counter(), int(sum(toxic))
    n0 = len(texts) - n1
    memo: dict[str, list[str]] = {}
    for text, t in zip(texts, toxic, strict=True):
        seen: set[str] = set()
        for w in set(TOKEN.findall(text.lower())):
            if (fs := memo.get(w)) is None:
                fs = memo[w] = features(w)
            seen.update(fs)
        (y1 if t else y0).update(seen)
    model = Model()
    if not n1 or not n0:
        model.intercept = 0.0 if not texts else float(np.clip(np.log((n1 + 0.5) / (n0 + 0.5)), -4, 4))
        model.slope = 0.0
        return model
    model.weights = log_odds(y1, y0, n1, n0)
    data = pa.array(texts, pa.string())
    raw, offs = buffers(data)
    distinct, codes, first = word_chunks(raw, offs)
    model.drift = 0.0  # until it is estimated, from the toxic-leaning tokens' share in and out of toxic passages
    is_hit = np.array([model.chunk(c) for c in distinct])[codes] > 0
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    label = np.array(toxic, bool)
    clean_n = max(int((~label[doc]).sum()), 1)
    f0 = (int((is_hit & ~label[doc]).sum()) + 0.5) / (clean_n + 1)
    inside = total = 0
    edge = np.searchsorted(hits := np.flatnonzero(is_hit), first)
    for i in np.flatnonzero(label):
        own = hits[edge[i] : edge[i + 1]]
        if len(own) > 1:
            inside, total = inside + len(own), total + int(own[-1] - own[0]) + 1
    f1 = (inside + 0.5) / (total + 1) if total else 0.1
    model.drift = float(max(np.log((1 - f0) / max(1 - f1, 1e-6)), 1e-3))
    # Lambda: the positive root of E[exp(lambda s)] = 1 over the clean tokens, of which one more would be toxic-leaning.
    sc, times = np.unique(np.array([model.chunk(c) for c in distinct])[codes][~label[doc]], return_counts=True)
    sc = np.append(sc, [max(model.weights.values(), default=1.0), -model.drift])
    weight = np.append(times, [0.5, 0.5]) / (clean_n + 1)
    low, high = 1e-4, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float((weight * np.exp(np.clip(mid * sc, -50, 50))).sum()) < 1 else (low, mid)
    model.scale = (low + high) / 2
    # Location of the law from the clean texts' best segments: mean = log(K n) + Euler's constant.
    e, _ = model.evidence(data)
    clean = e[~label & (np.diff(edge) > 0)]
    if len(clean) >= 20:
        model.log_k = float(np.clip(np.median(clean) - 0.3665, -10, 10))
        e, _ = model.evidence(data)
    model.slope, model.intercept = logistic(squash(e), label.astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """Slope (at least 0) and intercept by Newton's method, with Platt's smoothed targets and standardised x."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m, s = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - m) / s, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + l2 * len(x) * np.diag([1e-3, 1e-6]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (t - p) - l2 * len(x) * np.array([1e-3, 1e-6]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    a = max(float(w[0]) / s, 0.0)
    return a, float(w[1]) - a * m


def fit_model(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits, in one task of an executor, on ``sample_rows`` labelled, not held out rows of ``sample_bytes`` bytes at most.

    Keys are drawn from the labels first, so that what is broadcast is bounded by ``sample_rows``; the rows that have
    those keys, however many repeat one, are drawn from again. Both bounds are exact (see ``sample``)."""
    told = labels.select(F.col(key).cast("string").alias("k"), (F.col(label).cast("int") > 0).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out("k"))
    own = sample(told, sample_rows, 64 * sample_rows, "k", "k", "y").select(F.col("text").alias("k"), F.col("label").alias("y"))
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(own), "k")
    rows = materialize(rows, "labelled")
    got = fit_in_task(sample(rows, sample_rows, sample_bytes, "k", "t", "y"), lambda texts, toxic: pickle.dumps(train(texts, toxic)))
    release(rows)
    return pickle.loads(got) if got else train([], [])


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, passages) for every row, from the whole text; no shuffle.

    passages: (first word, last word, evidence) of each significant segment. Null and empty texts have no evidence and
    the low score that goes with it; repeated rows get equal results; without labels of both classes every score is the
    same. Labels, lang, source and the key are no inputs of a score; extra columns are ignored."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                e, found = model.evidence(piece.column(1))
                passages = pa.array([[{"first": a, "last": b, "evidence": s} for a, b, s in x] for x in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.score(e)), passages], names=[key, "score", "passages"])

    out = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, passages array<struct<first:long,last:long,evidence:double>>")
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
