"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties); the softmax temperature is then
calibrated on a part of the sample that the weights haven't seen. N-grams lie within words (blank-padded), and term
frequencies are relative, so a text's logits are a weighted mean over its words: each distinct word is scored once.
"""

from __future__ import annotations

import pickle
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import buffers, slices, word_chunks
from tidemark.llm.training import fit_in_task, held_out, sample

LETTERS = regex.compile(r"\p{L}+")
UND = "und"
#: Bytes at the edges of a word that are no letters.
EDGES = bytes(range(65)) + b"[\\]^_`{|}~\x7f"
#: Words that a worker keeps, of so many bytes at most each, and numbers that it keeps for them and for one slice of texts.
MEMO, MEMO_BYTES, MEMO_VALUES = 400_000, 48, 4_000_000
#: Words whose n-grams training remembers, about.
WORDS = 60_000


def word_grams(word: str, orders: tuple[int, ...]) -> list[str]:
    """Character n-grams of the lower-case letter runs of a word, each run padded by blanks."""
    return [p[i : i + n] for run in LETTERS.findall(word.lower()) for p in (f" {run} ",) for n in orders for i in range(len(p) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x languages, IDF and scale included
    bias: np.ndarray
    orders: tuple[int, ...]
    temperature: float = 1.0
    memo: dict[bytes, int] = field(default_factory=dict)  # words seen by this worker: their rows in ``values``
    values: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "values": None}

    @property
    def slice_bytes(self) -> int:
        """Bytes of text that are scored at once: their distinct words need a number for each language."""
        return min(8 << 20, 16 * MEMO_VALUES // (len(self.langs) + 1))

    def word(self, word: str) -> np.ndarray:
        """Summed weights of a word's n-grams for each language, and how many n-grams there are."""
        grams = word_grams(word, self.orders)
        known = [i for g in grams if (i := self.index.get(g)) is not None]
        return np.append(self.weights[known].sum(axis=0), len(grams))

    def words(self, distinct: list[bytes]) -> np.ndarray:
        """``word`` of each chunk; short ones are remembered, long ones are scored anew."""
        if self.values is None or len(self.memo) + len(distinct) > len(self.values):
            self.memo, self.values = {}, np.empty((max(min(MEMO, MEMO_VALUES // (len(self.langs) + 1)), 2 * len(distinct)), len(self.langs) + 1))
        memo, values, long = self.memo, self.values, []
        at = np.empty(len(distinct), np.int64)
        for k, w in enumerate(distinct):
            core = w.strip(EDGES)
            if (i := memo.get(core)) is None:
                if len(core) > MEMO_BYTES:
                    long.append((k, self.word(core.decode("utf-8", "replace"))))
                    i = 0
                else:
                    i = memo[core] = len(memo)
                    values[i] = self.word(core.decode("utf-8", "replace"))
            at[k] = i
        out = values[at]
        for k, row in long:
            out[k] = row
        return out

    def logits(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Logits and n-gram counts of an Arrow string column."""
        data, offs = buffers(texts)
        distinct, codes, first = word_chunks(data, offs)
        values = self.words(distinct)
        sums = np.zeros((len(offs) - 1, len(self.langs) + 1))
        for c in range(values.shape[1]):
            total = np.append(0.0, np.cumsum(values[codes, c]))
            sums[:, c] = total[first[1:]] - total[first[:-1]]
        n = sums[:, -1]
        return sums[:, :-1] / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ``und`` with score 0 for texts without a letter. Ties go to the first language in order."""
        z, n = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[b] if k else UND for b, k in zip(best, n, strict=True)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, d: int, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """FTRL-proximal weights (d x k) over sparse rows (indices, values), one row at a time in a fixed shuffled order."""
    z, n = np.zeros((d, k)), np.zeros((d, k))

    def of(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(x)):
            i, v = x[r]
            w = of(i)
            p = softmax((v @ w)[None, :])[0]
            p[y[r]] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return of(np.arange(d))


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(z / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Counts(NamedTuple):
    """Numbers of all n-grams; text i has the n-grams ``ids[first[i]:first[i + 1]]``, so many times each."""

    number: dict[str, int]
    ids: np.ndarray
    times: np.ndarray
    first: np.ndarray


def count_grams(texts: list[str], orders: tuple[int, ...]) -> Counts:
    """Texts are counted one by one into flat integer arrays, so besides the n-grams and WORDS remembered words no Python
    object outlives its text."""
    number: dict[str, int] = {}
    memo: dict[str, np.ndarray] = {}
    ids, times, first = array("i"), array("i"), array("q", [0])
    for text in texts:
        words = Counter(text.split())
        if len(memo) > WORDS:
            memo.clear()
        parts = []
        for w in words:
            if (own := memo.get(w)) is None:
                own = np.array([number.setdefault(g, len(number)) for g in word_grams(w, orders)], np.int32)
                if len(w) <= MEMO_BYTES:
                    memo[w] = own
            parts.append(own)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        own, where = np.unique(flat, return_inverse=True)
        often = np.bincount(where, np.repeat(list(words.values()), [len(p) for p in parts]), len(own)) if len(own) else own
        ids.frombytes(own.astype(np.int32).tobytes())
        times.frombytes(often.astype(np.int32).tobytes())
        first.append(len(ids))
    return Counts(number, *(np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (ids, times)), np.frombuffer(first, np.int64))


def train(texts: list[str], langs: list[str], orders: tuple[int, ...] = (1, 2, 3), features: int = 20_000, min_docs: int = 2) -> Model:
    """Fits the model. Every fifth text serves calibration only. The ``features`` n-grams of the most documents are used.
    A language needs one text; with a single language all scores are 1."""
    names = sorted(set(langs))
    counts = count_grams(texts, orders)
    keep = np.flatnonzero(np.diff(counts.first)).tolist()
    grams = list(counts.number)
    df = np.bincount(counts.ids, minlength=len(grams))  # a text holds a number once
    least = min_docs if len(keep) > 50 else 1
    chosen = sorted(np.flatnonzero(df >= least).tolist(), key=lambda i: (-df[i], grams[i]))[:features]
    chosen.sort(key=lambda i: grams[i])
    vocab = [grams[i] for i in chosen]
    place = np.full(len(grams), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    idf = np.log((1 + len(keep)) / (1 + df[chosen])) + 1 if vocab else np.zeros(0)
    scale = 30.0  # relative frequencies are small; this only sets the unit of the weights
    counts.number.clear()
    del grams, df, chosen

    x = []
    for i in keep:
        ids, n = (c[counts.first[i] : counts.first[i + 1]] for c in (counts.ids, counts.times))
        own = place[ids]
        order = np.argsort(own[own >= 0], kind="stable")
        own, v = own[own >= 0][order], (n[own >= 0] / max(n.sum(), 1))[order]
        x.append((np.append(own, np.int32(len(vocab))), np.append(v * idf[own] * scale, 1.0)))
    del counts
    y = np.array([names.index(langs[i]) for i in keep], np.int64)
    fit = [j for j in range(len(x)) if j % 5 or len(x) < 10]
    w = ftrl([x[j] for j in fit], y[fit], len(vocab) + 1, len(names)) if x else np.zeros((len(vocab) + 1, len(names)))
    model = Model(names, {}, w[:-1] * (idf * scale)[:, None], w[-1], orders)
    test = [j for j in range(len(x)) if not (j % 5 or len(x) < 10)]
    if test and len(names) > 1:
        z = np.array([x[j][1] @ w[x[j][0]] for j in test])
        model.temperature = calibrate(z, y[test])
    used = np.abs(model.weights).sum(axis=1) > 0
    model.index = {g: i for i, g in enumerate(g for g, u in zip(vocab, used, strict=True) if u)}
    model.weights = model.weights[used]
    return model


def fit_model(docs: DataFrame, sample_rows: int = 2000, sample_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fits, in one task of an executor, on ``sample_rows`` labelled rows of ``sample_bytes`` bytes at most, none of them
    held out. Both bounds are exact (see ``sample``); a rare language gets one row at least. None without labels."""
    rows = docs.select(key, text, lang).where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    got = fit_in_task(sample(rows, sample_rows, sample_bytes, key, text, lang), lambda texts, langs: pickle.dumps(train(texts, langs)))
    return pickle.loads(got) if got else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row, from the whole text; no shuffle.

    Null texts and those without a letter are ``und`` with score 0, and so is everything if no label could be learnt
    from. Repeated rows get equal results; null keys are not held out; extra columns, lang and source are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, model.slice_bytes if model else 8 << 20):
                langs, score = model.predict(piece.column(1)) if model else ([UND] * piece.num_rows, np.zeros(piece.num_rows))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    out = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
    return out.select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """``docs``, with its own columns whatever their names, without rows whose language is ``und`` or whose score is below
    ``min_score``. Null, empty and letterless texts are ``und`` and go, as does every row without a model; repeated rows
    are judged alike and null keys don't matter; an empty table gives no rows; whole texts of any length are read."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, model.slice_bytes if model else 8 << 20):
                langs, score = model.predict(piece.column(at)) if model else ([UND] * piece.num_rows, np.zeros(piece.num_rows))
                yield piece.filter(pa.array([x != UND and s >= min_score for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
