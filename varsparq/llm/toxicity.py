"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (first letters of words), proposed from labelled training rows; each votes
toxic where it occurs and abstains elsewhere; one more voter votes harmless where none of them occurs. A generative model of the votes,
fitted without labels by expectation maximisation, estimates the accuracy of each voter; voters that vote together far
more often than the model allows for are correlated and share one vote. A linear classifier on hashed words and first
letters is trained on the posteriors and scores every text.

Defined cases: null and empty texts have no feature and score what the classifier gives for none. Rows with a null id are
scored and not held out; they have no label. Without training rows of both labels all scores are 0. Repeated rows score
alike. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import map_texts

#: Bits of a hashed feature; letters of a pattern, in bytes.
BITS, PREFIXES = 20, (4, 5, 6)
#: A voter occurs in so many toxic training rows, in this share of them, and so much more often than in others.
MOST_VOTERS, LEAST_SEEN, LEAST_SHARE, LEAST_RATIO = 400, 5, 0.03, 12.0
THRESHOLD = 0.3
#: The classifier uses features whose rows have so many times the mean posterior, and hold this share of all posterior.
LIFT, MASS = 4.0, 0.005


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of a whole text: words without signs around them, and their first bytes, lower-cased."""
    from varsparq.llm.texts import mix, powers, word_bounds

    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    keep = _LETTER[np.frombuffer(raw, np.uint8)]
    raw = np.where(keep, np.frombuffer(raw, np.uint8), 32).astype(np.uint8).tobytes()
    data, starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.int64)
    length = ends - starts
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(max(PREFIXES), np.uint64)])
    out = []
    h = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        h = h + np.where(k < length, padded[starts + k], 0).astype(np.uint64) * powers(k + 1)[k]
        if k + 1 in PREFIXES:
            long = length > k + 1
            out.append(mix(h[long] + np.uint64(1000 + k)))
    at = np.arange(len(data))
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    part = padded[: len(data)] * powers(int(at.max()) + 1)[at]
    part[data == 32] = 0
    out.append(mix(np.add.reduceat(part, starts) + length.astype(np.uint64)))
    return np.unique(np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256), 39]] = True


def voters(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that occur LEAST_RATIO times as often in toxic training rows as in others: the lexicon and patterns that vote."""
    seen = np.zeros((2, 1 << BITS))
    for x, t in zip(rows, toxic, strict=True):
        seen[int(t), x] += 1
    n = np.bincount(toxic.astype(int), minlength=2)
    ratio = ((seen[1] + 0.5) / (n[1] + 1)) / ((seen[0] + 0.5) / (n[0] + 1))
    good = np.flatnonzero((seen[1] >= max(LEAST_SEEN, LEAST_SHARE * n[1])) & (ratio >= LEAST_RATIO))
    return good[np.argsort(-seen[1, good], kind="stable")[:MOST_VOTERS]]


def label_model(votes: np.ndarray, prior: float, rounds: int = 100) -> np.ndarray:
    """Posterior of toxic for each row of votes (rows, voters) in {0, 1}, fitted without labels but for ``prior``, the share of toxic rows.

    A latent class with conditional rates of voting in either class, for each voter and for the one that votes where no
    other does. Voters whose votes agree beyond that (by the residual correlation within the classes, taken anew in each
    round) share their weight. Rounds end when no posterior moves by 1e-4; it begins at 0.9 for rows with a vote, 0.02 for others.
    """
    p = np.where(votes.any(1), 0.9, 0.02)
    votes = np.column_stack([votes, ~votes.any(1)]).astype(float)
    n, prior = len(votes), np.clip(prior, 1e-3, 0.5)
    for _ in range(rounds):
        rate_1 = (votes.T @ p + 0.5) / (p.sum() + 1)
        rate_0 = (votes.T @ (1 - p) + 0.5) / ((1 - p).sum() + 50)
        left = votes - np.outer(p, rate_1) - np.outer(1 - p, rate_0)
        spread = np.sqrt((left**2).mean(0)) + 1e-9
        link = np.abs(left.T @ left / n) / np.outer(spread, spread)
        weight = 1 / np.maximum(1, np.clip((link - 0.4) / 0.2, 0, 1).sum(1))  # from no link at 0.4 to a whole one at 0.6
        odds = np.log(prior / (1 - prior)) + votes @ (np.log(rate_1 / rate_0) * weight)  # abstaining says nothing
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-4:
            break
    return p


def train_linear(rows: list[np.ndarray], target: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features that the targets favour, with soft targets, by gradient steps scaled for each feature."""
    count, mass = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for x, t in zip(rows, target, strict=True):
        count[x] += 1
        mass[x] += t
    use = (mass >= max(2.0, MASS * target.sum())) & (mass >= LIFT * target.mean() * count)
    rows = [x[use[x]] for x in rows]
    weights, scale, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), -3.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weights[x].sum() + bias, -30, 30))) - target[i]
            scale[x] += g * g
            weights[x] -= 0.3 * (g + 1e-4 * weights[x]) / np.sqrt(scale[x] + 0.1)
            bias -= 0.02 * g
    return weights, bias


class Model:
    """A linear classifier with few weights kept: those of the features that training moved far enough to matter."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[x].sum(dtype=np.float64) + self.bias, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000) -> Model | None:
    """Train on at most ``fit_rows`` labelled rows of the training folds (those of the smallest hashes of ids)."""
    train = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("doc_id", "text", "toxic")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2).cast(pa.int32())], ["doc_id", "x", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_texts(texts, rows, f"doc_id {kind}, x array<int>, toxic int").orderBy("doc_id", F.hash("x")).toPandas()
    toxic = sample["toxic"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return None
    sample = sample[~sample["x"].map(lambda v: np.asarray(v, np.int32).tobytes()).duplicated()]  # copies would make chance words look like evidence
    toxic = sample["toxic"].to_numpy() > 0
    x = [np.asarray(v, np.int32) for v in sample["x"]]
    del sample
    chosen = voters(x, toxic)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    votes = np.zeros((len(x), max(len(chosen), 1)), bool)
    for i, v in enumerate(x):
        at = place[v]
        votes[i, at[at >= 0]] = True
    posterior = label_model(votes, float(toxic.mean()))
    return Model(*train_linear(x, posterior))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    model = fit(docs, labels, **options)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = [model.score(features(t)) if model else 0.0 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_texts(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
