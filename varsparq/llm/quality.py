"""Quality rules: rule statistics of each document, and isolation forests over them.

A tree of a forest splits all labelled documents at random values of random statistics. Documents that few splits set
apart are anomalous. There is a forest for each statistic and one for all together, each with a threshold that comes
from the same rows; one forest suffices to reject. (A single joint forest hides rows of junk that are alike in one
statistic behind clean rows that differ in others.) Trees of all forests grow a level at a time: tasks tell how many rows
reach each node and between which values, and Spark puts these together, so a fit reads every row and none leaves its task.

Defined cases: a null text has no words; an empty text likewise, and both fail the base rules. Repeated rows are
judged one by one and alike. Rows with a null id are judged; they have no label. An empty table gives an empty result.
Without labelled rows of both kinds the forest rejects nothing. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import map_texts, materialise, text_batches

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WHITE = " \t\n\v\f\r"
#: A forest takes part if it rejects this share of the bad labelled rows beyond what forests before it reject.
LEAST_GAIN = 0.01
#: Levels of a tree, at most.
DEPTH = 8
#: Steps of a score at which thresholds lie.
STEPS = 2000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of STATS for one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest sees: statistics in proportion to the length of the document."""
    n, chars, symbols, dup, repeat, lines = stats.T.astype(float)
    some = np.maximum(n, 1)
    return np.column_stack([symbols / some, dup / np.maximum(lines, 1), repeat / some, chars / some])


@dataclass
class Forest:
    """Trees as complete binary trees in arrays of shape (trees, nodes); a feature below 0 marks a leaf. columns: the features it uses."""

    columns: list[int]
    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): the shorter the mean path, the higher."""
        x = x[:, self.columns]
        tree = np.arange(self.feature.shape[0])[None, :]
        node = np.zeros((len(x), self.feature.shape[0]), np.int64)
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[tree, node]
            if (f < 0).all():
                return np.exp2(-self.path[tree, node].mean(1) / self.scale)
            below = 2 * node + 1 + (x[row, np.maximum(f, 0)] >= self.split[tree, node])
            node = np.where(f < 0, node, below)


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def reached(forests: list[Forest], level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, low, high) of the nodes of a level, tree by tree: how many rows of ``x`` reach each, and between which values of the features."""
    wide, trees = 2**level, sum(len(f.feature) for f in forests)
    n = np.zeros(trees * wide, np.int64)
    low, high = np.full((trees * wide, x.shape[1]), np.inf), np.full((trees * wide, x.shape[1]), -np.inf)
    first = 0
    for forest in forests:
        tree = np.arange(len(forest.feature))[None, :]
        node = np.zeros((len(x), len(forest.feature)), np.int64)
        on = np.ones(node.shape, bool)
        for _ in range(level):
            f = forest.feature[tree, node]
            on &= f >= 0
            column = np.array(forest.columns)[np.maximum(f, 0)]
            node = np.where(on, 2 * node + 1 + (x[np.arange(len(x))[:, None], column] >= forest.split[tree, node]), node)
        row, _ = np.nonzero(on)
        at = ((first + tree) * wide + node - (wide - 1))[on]
        n += np.bincount(at, minlength=len(n))
        for c in forest.columns:
            np.minimum.at(low[:, c], at, x[row, c])
            np.maximum.at(high[:, c], at, x[row, c])
        first += len(forest.feature)
    return n, low, high


def grow(groups: list[list[int]], trees: int, rows: int, told: Callable[[list[Forest], int], tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 7) -> list[Forest]:
    """An isolation forest over each group of features of ``rows`` rows; ``told`` gives what reached() does over all of them."""
    depth = min(DEPTH, max(1, math.ceil(math.log2(max(rows, 2)))))
    nodes = 2 ** (depth + 1) - 1
    scale = max(_mean_path(rows), 1e-9)
    forests = [Forest(columns, np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), scale) for columns in groups]
    rng = np.random.default_rng(seed)
    for level in range(depth + 1):
        n, low, high = told(forests, level)
        draw = rng.random((len(n), 2))
        for at in np.flatnonzero(n):
            forest, t, node = forests[at // 2**level // trees], at // 2**level % trees, 2**level - 1 + at % 2**level
            a, b = low[at, forest.columns], high[at, forest.columns]
            varied = np.flatnonzero(b > a)
            if level == depth or not len(varied):
                forest.path[t, node] = level + _mean_path(int(n[at]))
                continue
            f = varied[int(draw[at, 0] * len(varied))]
            split = a[f] + (b[f] - a[f]) * draw[at, 1]
            forest.feature[t, node], forest.split[t, node] = f, split if split > a[f] else b[f]
    return forests


def fit_forest(x: np.ndarray, columns: list[int], trees: int = 40, seed: int = 7) -> Forest:
    """Isolation forest over ``columns`` of an array of features."""
    return grow([columns], trees, len(x), lambda forests, level: reached(forests, level, x), seed)[0]


def fit_forests(known: DataFrame, groups: list[list[int]], trees: int = 40, seed: int = 7) -> list[Forest]:
    """The same over all rows of ``known``, a table with STATS; the driver sees three numbers a node and feature."""
    size = 4

    def told(forests: list[Forest], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in it:
                if batch.num_rows:
                    n, low, high = reached(forests, level, features(np.column_stack([batch.column(s).to_numpy() for s in STATS])))
                    total = (n, low, high) if total is None else (total[0] + n, np.minimum(total[1], low), np.maximum(total[2], high))
            if total is not None:
                n, low, high = total
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(e[at, c]) for e in (low, high) for c in range(size))], [f.split(" ")[0] for f in fields])

        fields = ["at long", "n long", *(f"{e}{c} double" for e in ("low", "high") for c in range(size))]
        parts = known.select(*STATS).mapInArrow(rows, ", ".join(fields))
        found = parts.groupBy("at").agg(F.sum("n").alias("n"), *(F.min(f"low{c}").alias(f"low{c}") for c in range(size)), *(F.max(f"high{c}").alias(f"high{c}") for c in range(size))).collect()  # nodes of a level
        places = len(groups) * trees * 2**level
        n, low, high = np.zeros(places, np.int64), np.full((places, size), np.inf), np.full((places, size), -np.inf)
        for r in found:
            n[r.at], low[r.at], high[r.at] = r.n, r[2 : 2 + size], r[2 + size :]
        return n, low, high

    return grow(groups, trees, known.count(), told, seed)


def best_threshold(counts: list[tuple[int, int, int]], steps: int, max_false_rejects: float) -> float:
    """The score from which on documents are rejected. counts: (score bucket, quality, documents)."""
    good, bad = np.zeros(steps + 1), np.zeros(steps + 1)
    for bucket, quality, n in counts:
        (good if quality else bad)[bucket] += n
    if not good.sum() or not bad.sum():
        return 2.0
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    lost = good[::-1].cumsum()[::-1] / good.sum()
    gain = np.where(lost <= max_false_rejects, caught - lost, -1.0)
    best = int(len(gain) - 1 - np.argmax(gain[::-1]))
    return best / steps if gain[best] >= LEAST_GAIN else 2.0


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of each row of ``docs``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([rule_statistics(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], [id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), rows, f"{id_col} {kind}, " + ", ".join(f"{s} long" for s in STATS))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", trees: int = 40, max_false_rejects: float = 0.001) -> list[Forest]:
    """Fit, calibrate and choose forests on all labelled rows.

    ``labels`` has id_col and quality (0 or 1); of several labels of a document the lowest holds.
    """
    truth = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    known = stats.where(F.col("n_words") >= MIN_WORDS).join(truth, id_col).select(*STATS, (F.col("quality") > 0).cast("int").alias("good"))
    known = materialise(known, "rule-labelled")  # numbers only
    if not known.take(1):
        return []
    every = list(range(4))
    forests = fit_forests(known, [*([c] for c in every), every], trees)

    @F.pandas_udf("array<int>")
    def buckets(*columns):  # noqa: ANN002, ANN202  pandas series
        import pandas as pd

        x = features(np.column_stack([c.to_numpy(np.int64) for c in columns]))
        return pd.Series(list(np.column_stack([(f.score(x) * STEPS).astype(np.int32) for f in forests])))

    scored = materialise(known.select("good", buckets(*STATS).alias("buckets")), "rule-scores")
    counts = scored.select("good", F.posexplode("buckets").alias("forest", "bucket")).groupBy("forest", "bucket", "good").count().collect()  # at most forests x steps x 2 rows
    for k, forest in enumerate(forests):
        forest.threshold = best_threshold([(r.bucket, r.good, r["count"]) for r in counts if r.forest == k], STEPS, max_false_rejects)
    against = F.array(*(F.col("buckets")[k] >= f.threshold * STEPS - 1e-6 for k, f in enumerate(forests)))
    bad = scored.where("good = 0").groupBy(against.alias("by")).count().collect()  # 2 to the number of forests at most
    caught = lambda k, rows: sum(r["count"] for r in rows if r.by[k])
    total = sum(r["count"] for r in bad)
    kept: list[Forest] = []
    left = bad
    for k in sorted((k for k, f in enumerate(forests) if f.threshold <= 1), key=lambda k: -caught(k, bad)):
        if caught(k, left) >= LEAST_GAIN * total:
            kept.append(forests[k])
            left = [r for r in left if not r.by[k]]
    return kept


def anomaly(forests: list[Forest], stats: np.ndarray) -> np.ndarray:
    """The highest score in proportion to its threshold: 1 and above is rejected."""
    x = features(stats)
    return np.max([np.zeros(len(x)), *((f.score(x) * STEPS).astype(np.int32) / (f.threshold * STEPS) for f in forests)], axis=0)


def judge(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """Adds base_failed, anomaly (double) and kept to a table with STATS."""

    @F.pandas_udf("double")
    def score(*columns):  # noqa: ANN002, ANN202  pandas series
        import pandas as pd

        return pd.Series(anomaly(forests, np.column_stack([c.to_numpy(np.int64) for c in columns])))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("anomaly", score(*STATS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < 1 - 1e-9))


def quality_rules(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly of each row of ``docs``.

    Texts are read once; the statistics (numbers only) go to the shared folder, and fit and verdict read them there.
    """
    stats = materialise(statistics_table(docs), "rule-stats")
    return judge(stats, fit(stats, labels, **options)).select("doc_id", *STATS[:-1], "base_failed", "kept", "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. A second pass judges rows where they lie: no text is shuffled."""
    forests = fit(materialise(statistics_table(docs), "rule-stats"), labels, **options)
    text_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202  pandas series
        import pandas as pd

        stats = np.array([rule_statistics(x) for x in texts], np.int64).reshape(-1, len(STATS))
        bad = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
        return pd.Series(~bad & (anomaly(forests, stats) < 1 - 1e-9))

    return docs.where(good("text"))
