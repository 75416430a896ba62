"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages, windows of `PASSAGE` bytes without overlap that cover the whole text. Every passage is
described by the shares of byte kinds and of hashed byte pairs and by how much it repeats itself, and encoded by a
learned layer. Gated attention gives each passage a weight: `softmax(w . (tanh(V h) * sigmoid(U h)))` over the bag. The
weighted passage representation is scored by a logistic output. Encoder, attention and output are trained together in
numpy on the driver from document labels alone, on a bounded sample (`Sampling`) of labelled rows.

Scores read the text only. Null and empty texts are bags of one empty passage and get the score the model gives those;
with nothing to learn from every score is 0.5. Repeated rows get equal scores; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import plain, restored, shielded, text_chunks

PASSAGE, PAIRS, HIDDEN, ATTENTION = 512, 64, 24, 12
NAMED = b" \n.,%&#$*!|?-/@:;\"'()<>[]{}=+_"
LOWER, UPPER, DIGIT, HIGH, OTHER, PAD = range(len(NAMED), len(NAMED) + 6)
KINDS = len(NAMED) + 5


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = LOWER, UPPER, DIGIT, HIGH
    for i, b in enumerate(NAMED):
        kind[b] = i
    kind[0] = PAD
    return kind


KIND = _kinds()


@dataclass(frozen=True)
class Sampling:
    """Bounds of the training sample: documents per label, and characters of the excerpt that is learned from."""

    per_label: int = 2500
    chars: int = 6000


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all passages, padded with zeros; how many bytes each has; the first passage of each text."""
    cut, sizes, first, n = [], [], [], 0
    for t in texts:
        b = t.encode("utf-8", "replace").replace(b"\0", b" ")
        count = max(1, -(-len(b) // PASSAGE))
        cut.append(b.ljust(count * PASSAGE, b"\0"))
        sizes += [PASSAGE] * (count - 1) + [len(b) - (count - 1) * PASSAGE]
        first.append(n)
        n += count
    return np.frombuffer(b"".join(cut), dtype=np.uint8).reshape(-1, PASSAGE), np.array(sizes), np.array(first)


def describe(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of each passage: shares of kinds and pairs, variety of short runs, spread of word lengths, size."""
    n = len(x)
    rows = np.arange(n, dtype=np.int64)[:, None]
    kind = KIND[x]
    size = np.maximum(sizes, 1)[:, None]
    kinds = np.bincount((rows * (PAD + 1) + kind).ravel(), minlength=n * (PAD + 1)).reshape(n, PAD + 1)[:, :KINDS] / size
    pair = (x[:, :-1].astype(np.uint32) * 2654435 + x[:, 1:].astype(np.uint32) * 40503) >> 7 & (PAIRS - 1)
    pair = np.where(x[:, 1:] > 0, pair, PAIRS)
    pairs = np.bincount((rows * (PAIRS + 1) + pair).ravel(), minlength=n * (PAIRS + 1)).reshape(n, PAIRS + 1)[:, :PAIRS] / size
    wide = x.astype(np.uint64)
    run = (wide[:, :-5] << 40 | wide[:, 1:-4] << 32 | wide[:, 2:-3] << 24 | wide[:, 3:-2] << 16 | wide[:, 4:-1] << 8 | wide[:, 5:]) + 0
    run.sort(axis=1)
    distinct = (run[:, 1:] != run[:, :-1]).sum(axis=1)[:, None] / size
    space = (kind == 0) | (kind == 1)
    words = space.sum(axis=1)[:, None] + 1
    return np.concatenate([kinds * 4, pairs * 4, distinct, words / size, np.log1p(sizes)[:, None] / 6], axis=1).astype(np.float32)


FEATURES = KINDS + PAIRS + 3


def describe_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, sizes, first = passages(texts)
    out = np.empty((len(x), FEATURES), dtype=np.float32)
    for start in range(0, len(x), 1024):
        out[start : start + 1024] = describe(x[start : start + 1024], sizes[start : start + 1024])
    return out, first


def initial(seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    zero = lambda n: np.zeros(n, dtype=np.float32)
    return [draw(FEATURES, HIDDEN), zero(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION, 1), draw(HIDDEN, 1), zero(1)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(p: list[np.ndarray], f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Score of every bag, and what the backward pass needs."""
    enc, enc_b, v, u, w, out, out_b = p
    h = np.tanh(f @ enc + enc_b)
    tv, su = np.tanh(h @ v), _sigmoid(h @ u)
    a = ((tv * su) @ w)[:, 0]
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(f))))
    e = np.exp(a - np.maximum.reduceat(a, first)[bag])
    weight = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(h * weight[:, None], first, axis=0)
    return _sigmoid(z @ out + out_b)[:, 0], (h, tv, su, bag, weight, z)


def gradients(p: list[np.ndarray], f: np.ndarray, first: np.ndarray, y: np.ndarray, balance: np.ndarray) -> list[np.ndarray]:
    enc, _, v, u, w, out, _ = p
    score, (h, tv, su, bag, weight, z) = forward(p, f, first)
    d = ((score - y) * balance / len(y)).astype(np.float32)[:, None]
    dz = d @ out.T
    dh = weight[:, None] * dz[bag]
    dweight = (h * dz[bag]).sum(axis=1)
    mean = np.add.reduceat(dweight * weight, first)[bag]
    da = (weight * (dweight - mean))[:, None]
    gate = da @ w.T
    dtv, dsu = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
    dh = (dh + dtv @ v.T + dsu @ u.T) * (1 - h**2)
    return [f.T @ dh, dh.sum(0), h.T @ dtv, h.T @ dsu, (tv * su).T @ da, z.T @ d, d.sum(0)]


@dataclass
class Model:
    params: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        f, first = describe_all(texts)
        return forward(self.params, (f - self.mean) / self.spread, first)[0]


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.01, seed: int = 5) -> Model | None:
    if not texts:
        return None
    f, first = describe_all(texts)
    ends, y = np.append(first, len(f)), np.array(labels, dtype=np.float32)
    mean, spread = f.mean(axis=0), f.std(axis=0) + 0.02
    f = (f - mean) / spread
    p = initial(seed)
    rng = np.random.default_rng(seed)
    one, two, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    share = np.clip(y.mean(), 0.01, 0.99)
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(ends[batch + 1] - ends[batch])[:-1]])
            step += 1
            for i, g in enumerate(gradients(p, f[rows], starts, y[batch], balance[batch])):
                g = g + 1e-4 * p[i]
                one[i] = 0.9 * one[i] + 0.1 * g
                two[i] = 0.99 * two[i] + 0.01 * g * g
                p[i] -= rate * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-6)
    return Model([x.astype(np.float32) for x in p], mean, spread)


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sampling: Sampling) -> pd.DataFrame:
    """At most `per_label` labelled rows of either label, those with the lowest hash of the id, and an excerpt of each.

    Ids are chosen from the labels alone, so at most twice `per_label` of them are broadcast to the texts. Rows that
    repeat an id are kept down to the same bound.
    """
    # Shares of fewer than 1000 rows are cut down in every task before they are shuffled.
    shares = -(-sampling.per_label // 900)
    order = W.partitionBy("label", F.pmod("h", F.lit(shares))).orderBy("h", key)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    chosen = chosen.select(key, F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("h"))
    chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= -(-sampling.per_label // shares))
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.pmod(F.xxhash64(body), F.greatest(F.length(body) - sampling.chars, F.lit(0)) + 1) + 1
    excerpts = docs.select(key, body.substr(start.cast("int"), F.lit(sampling.chars)).alias("text"))
    rows = excerpts.join(F.broadcast(chosen), key).orderBy("n", "h", "label", "text").limit(2 * sampling.per_label)
    return rows.select("text", "label").toPandas()


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sampling: Sampling = Sampling()
) -> Model | None:
    sample = training_sample(docs, labels, key, text, label, sampling)
    return fit(sample["text"].tolist(), sample["label"].tolist())


@shielded("text")
def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with `score` (likelihood of label 1) and `predicted` (1 from `threshold`)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    before = docs.select(*kept).schema
    docs = plain(docs.select(*kept))
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame, text):
                bodies = [t if isinstance(t, str) else "" for t in part[text]]
                scores = model.scores(bodies).astype(float) if model else np.full(len(part), 0.5)
                yield part.assign(score=scores, predicted=(scores >= threshold).astype(int))

    return restored(docs.mapInPandas(run, schema), before)
