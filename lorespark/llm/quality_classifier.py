"""Quality classifier by positive-unlabelled learning.

A linear scorer over hashed words, hashed word shapes and a few text statistics minimises the non-negative
unbiased risk (Kiryo et al., 2017) of trusted positives and unlabelled text, under a class prior estimated from
the two score distributions by best-bin estimation (Garg et al., 2021). Labelled negatives are never used.

Defined results: a null or empty text has no words and only statistics of zero; with no trusted positives or no
unlabelled text there is nothing to learn and every score is 0.5. Equal texts get equal scores; null doc_ids
are scored like any other and never used for training; further columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

N_WORDS, N_SHAPES, N_STATS = 1024, 256, 14
SIZE = N_WORDS + N_SHAPES + N_STATS
#: Letters become x or X, digits 9, bytes past ASCII x; white space and signs stay.
SHAPE = bytes(ord("x") if 97 <= b < 123 or b > 127 else ord("X") if 65 <= b < 91 else ord("9") if 48 <= b < 58 else b for b in range(256))
RUN = re.compile(rb"([xX9])\1+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: two parts of unit length and the statistics."""
    raw = (text or "").encode("utf-8", "replace")
    order = raw.split()
    words, total = Counter(order), len(order)
    value = np.zeros(SIZE, np.float32)
    if total:
        shapes: Counter = Counter()
        for word, n in words.items():
            value[zlib.crc32(word) % N_WORDS] += n
            shapes[word.translate(SHAPE)] += n
        short: Counter = Counter()
        for shape, n in shapes.items():
            short[RUN.sub(rb"\1", shape)] += n
        for shape, n in short.items():
            value[N_WORDS + zlib.crc32(shape) % N_SHAPES] += n
        value[:N_WORDS] = np.sqrt(value[:N_WORDS] / total)
        value[N_WORDS : N_WORDS + N_SHAPES] = np.sqrt(value[N_WORDS : N_WORDS + N_SHAPES] / total)
        kind = np.bincount(np.frombuffer(raw.translate(SHAPE), np.uint8), minlength=128).astype(np.float64)
        size, lines, pairs = len(raw), raw.split(b"\n"), set(zip(order, islice(order, 1, None), strict=False))
        letters = kind[ord("x")] + kind[ord("X")]
        value[-N_STATS:] = (
            np.log1p(total) / 10, size / total / 20, len(words) / total, kind[ord("X")] / size, kind[ord("9")] / size,
            (size - letters - kind[ord("9")] - kind[[32, 9, 10, 11, 12, 13]].sum()) / size, sum(kind[ord(c)] for c in "#*$%&|<>") / size,
            kind[ord("!")] / size, len(set(lines)) / len(lines), max(words.values()) / total,
            sum(map(eq, order, islice(order, 1, None))) / total, len(words) / total**0.75, (len(pairs) + 1) / total, np.log2(total / len(pairs)) if pairs else 0.0,
        )
    at = np.flatnonzero(value)
    return at.astype(np.int16), value[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: np.ndarray, gradient, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam; gradient(scores) gives the risk's derivative by each row's score."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for k in range(1, steps + 1):
        g = gradient(x @ w[:-1].astype(np.float32) + w[-1])
        g = np.append(x.T @ g.astype(np.float32) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives in unlabelled rows: the least ratio of tail masses, at the tail of the best confidence."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.98, 99)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    doubt = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    best = int(np.argmin(u / p + (1 + slack) * doubt / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises prior * R+ + max(0, R-(unlabelled) - prior * R-(positive)) of the logistic loss."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE), 0.0, 0.5)

    def plain(p: np.ndarray, u: np.ndarray):
        x, n, k = np.concatenate([p, u]), len(p), len(u)
        sign = np.concatenate([np.ones(n), np.zeros(k)])
        share = np.concatenate([np.full(n, 0.5 / n), np.full(k, 0.5 / k)])
        return _descend(x, lambda s: (_sigmoid(s) - sign) * share, steps // 2, rate, 1e-3)

    # statistics in deviations, so that one step size suits them all; undone in the weights at the end
    scale = np.ones(SIZE, np.float32)
    scale[-N_STATS:] = 1 / np.maximum(unlabelled[:, -N_STATS:].std(0), 1e-3)
    n, k = len(positive), len(unlabelled)
    x = np.concatenate([positive, unlabelled])
    x *= scale
    positive, unlabelled = x[:n], x[n:]  # views: the sample is held once from here on
    # each half is scored by what the other half taught; less one standard error, as the least ratio errs upwards on small samples
    found = []
    for half in (0, 1):
        w, b = plain(*(rows[half::2] if len(rows) > 1 else rows for rows in (positive, unlabelled)))
        rest_p, rest_u = (rows[1 - half :: 2] if len(rows) > 1 else rows for rows in (positive, unlabelled))
        found.append(estimate_prior(rest_p @ w + b, rest_u @ w + b))
    prior = float(np.mean(found))
    prior = float(np.clip(prior - np.sqrt(prior * (1 - prior) / len(unlabelled)), 0.02, 0.98))

    def gradient(s: np.ndarray) -> np.ndarray:
        up = _sigmoid(s)  # derivative of the loss of calling a row negative; that of calling it positive is up - 1
        loss = np.logaddexp(0, s)
        negative = loss[n:].mean() - prior * loss[:n].mean()
        g = np.empty(n + k)
        if negative >= 0:
            g[:n], g[n:] = prior * (up[:n] - 1) / n - prior * up[:n] / n, up[n:] / k
        else:  # the negative part overfits: step back along it alone
            g[:n], g[n:] = prior * up[:n] / n, -up[n:] / k
        return g

    w, b = _descend(x, gradient, steps, rate, decay)
    return Model(w * scale, b, prior)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000) -> Model:
    """Learns from at most max_positive trusted positives and max_unlabelled rows of any kind, drawn by a hash of doc_id.

    The sample is bounded by these two parameters; only its hashed features come to the driver, at most about
    2 KB a row. Held-out and null doc_ids take no part.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    good = labels.where("quality = 1").select("doc_id").distinct()
    sparse = F.pandas_udf(_sparse, "struct<at:binary,value:binary>")

    def drawn(df: DataFrame, most: int) -> np.ndarray:
        n = df.count()
        if n > most:  # a share of all hashes that overshoots a little; the cut below is by the hash too
            df = df.where(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * most / n)))
        got = df.select(F.xxhash64(F.lit("draw"), "doc_id").alias("h"), "doc_id", sparse("text").alias("f")).orderBy("h", "doc_id", "f.at", "f.value").limit(most).collect()
        out = np.zeros((len(got), SIZE), np.float32)
        for k, r in enumerate(got):
            out[k, np.frombuffer(r.f.at, np.int16)] = np.frombuffer(r.f.value, np.float32)
        return out

    samples = [drawn(rows.join(good, "doc_id", "left_semi"), max_positive), drawn(rows, max_unlabelled)]
    return train(samples.pop(0), samples.pop())


def _sparse(texts: pd.Series) -> pd.DataFrame:
    rows = [features(t) for t in texts]
    return pd.DataFrame({"at": [a.tobytes() for a, _ in rows], "value": [v.tobytes() for _, v in rows]})


def scorer(model: Model):
    """A column function of the text."""
    weights, bias = model.weights.astype(np.float64), model.bias

    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            at, value = features(t)
            out[k] = value.astype(np.float64) @ weights[at] + bias
        return pd.Series(_sigmoid(out))

    return F.pandas_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """docs with held_out, score and predicted (columns of these names are replaced)."""
    model = fit(docs, labels, **bounds)
    out = docs.withColumn("score", scorer(model)("text")).withColumn("held_out", held_out("doc_id"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
