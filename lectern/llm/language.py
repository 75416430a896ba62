"""Language identification: a byte convolutional network over fixed-length windows.

Filters of several widths run over the bytes of a window; the network sees one-hot bytes, so a filter of width w is w
tables of a weight per byte value, and a convolution is a sum of table rows. Each filter keeps its highest response in
the window (max pooling), and a softmax over the filters gives the language of the window. A text is cut into windows
without overlap, all of them are read, and their probabilities are averaged.

The network is trained in numpy on the driver from at most `max_rows` labelled excerpts; prediction reads the text only.
A null text, or one without a letter, is `und` with score 0, and so is every text if there is nothing to learn from.
Labels that are null are not learned. Rows keep their other columns.
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

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
UNKNOWN = "und"

#: Case of A-Z carries no language, and neither does one digit rather than another.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48


@dataclass(frozen=True)
class Sampling:
    """Bounds of the training sample: excerpts per language, excerpts in all, characters of an excerpt."""

    per_label: int = 1000
    max_rows: int = 6000
    chars: int = 512


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, one below the other and padded with zeros, and the first window of each text."""
    cut, first, n = [], [], 0
    for t in texts:
        b = t.encode("utf-8", "replace")
        count = max(1, -(-len(b) // WINDOW))
        cut.append(b.ljust(count * WINDOW, b"\0"))
        first.append(n)
        n += count
    return FOLD[np.frombuffer(b"".join(cut), dtype=np.uint8)].reshape(-1, WINDOW), np.array(first)


def responses(x: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    width = len(tables)
    length = WINDOW - width + 1
    z = tables[0].take(x[:, :length], axis=0)
    for j in range(1, width):
        z += tables[j].take(x[:, j : j + length], axis=0)
    z += bias
    return z


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(net.labels)))
    for start in range(0, len(x), 256):
        part = x[start : start + 256]
        pooled = [np.maximum(responses(part, t, b).max(axis=1), 0) for t, b in zip(net.tables, net.bias, strict=True)]
        out[start : start + 256] = softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Train on whole excerpts: every window of an excerpt is an example of its language."""
    if not texts:
        return None
    names = sorted(set(labels))
    x, first = windows(texts)
    counts = np.diff(np.append(first, len(x)))
    y = np.repeat(np.array([names.index(label) for label in labels]), counts)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    params += [rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names)))).astype(np.float32)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            for i, g in enumerate(gradients(params, x[batch], y[batch], weight)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                params[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    n = len(WIDTHS)
    return Network(names, params[:n], params[n : 2 * n], params[-2], params[-1])


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n = len(WIDTHS)
    pooled, places = [], []
    for tables, bias in zip(params[:n], params[n : 2 * n], strict=True):
        z = responses(x, tables, bias)
        at = z.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :])
    pre = np.concatenate(pooled, axis=1)
    hidden = np.maximum(pre, 0)
    d = softmax(hidden @ params[-2] + params[-1])
    d[np.arange(len(y)), y] -= 1
    d = (d * weight[y][:, None] / len(y)).astype(np.float32)
    back = (d @ params[-2].T) * (pre > 0)
    tables_grad, bias_grad = [], []
    rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
    for k, at in enumerate(places):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        t = np.zeros_like(params[k])
        for j in range(WIDTHS[k]):
            np.add.at(t[j], (x[rows, at + j], filters), g)
        tables_grad.append(t)
        bias_grad.append(g.sum(axis=0))
    return [*tables_grad, *bias_grad, hidden.T @ d, d.sum(axis=0)]


def training_sample(labelled: DataFrame, text: str, label: str, sampling: Sampling) -> pd.DataFrame:
    """A bounded sample, even over the labels: the rows with the lowest hash, and an excerpt from a hashed place of each."""
    place = F.xxhash64(text, label)
    start = F.pmod(F.xxhash64(place), F.greatest(F.length(text) - sampling.chars, F.lit(0)) + 1) + 1
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) > 0)).select(
        F.col(text).substr(start.cast("int"), F.lit(sampling.chars)).alias("text"), F.col(label).alias("label"), place.alias("h")
    )
    order = W.partitionBy("label").orderBy("h")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sampling.per_label)
    return rows.orderBy("n", "h", "label").limit(sampling.max_rows).select("text", "label").toPandas()


def train(labelled: DataFrame, text: str = "text", label: str = "lang", sampling: Sampling = Sampling()) -> Network | None:
    sample = training_sample(labelled, text, label, sampling)
    return fit(sample["text"].tolist(), sample["label"].astype(str).tolist())


@shielded("text")
def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, the mean probability of that language over all windows of the text."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    before = docs.select(*kept).schema
    docs = plain(docs.select(*kept)).withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame, text):
                names, scores = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part))
                at = np.flatnonzero(part["_letter"].to_numpy(dtype=bool))
                if net is not None and len(at):
                    x, first = windows(part[text].iloc[at].tolist())
                    sums = np.add.reduceat(probabilities(net, x), first, axis=0)
                    means = sums / np.diff(np.append(first, len(x)))[:, None]
                    names[at] = np.array(net.labels, dtype=object)[means.argmax(axis=1)]
                    scores[at] = np.clip(means.max(axis=1), 0, 1)
                yield part.drop(columns="_letter").assign(lang_pred=names, score=scores)

    return restored(docs.mapInPandas(run, schema), before)
