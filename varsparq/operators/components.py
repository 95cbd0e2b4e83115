"""Principal components of a table of cells (i, j, v): rows are samples, columns features, a cell without a row is 0.

The covariance is never formed. Block orthogonal iteration applies it to a few vectors, means taken out implicitly. Where
there are up to NARROW columns, a row is one record, vectors go to the tasks, and a round shuffles sums of the block alone,
columns times vectors for each task. Else a round costs two joins with the cells and two shuffles of cells times block. A round adds the residuals of the best vectors so
far, made orthogonal, to the block; a block that has grown to GROWN times its size falls back to its best vectors. Memory
doesn't grow with rows or columns: tasks hold batches of them, the driver products of vectors of the block only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from varsparq.storage import materialise


@dataclass
class Components:
    """values: variances of the components, falling; total: variance of all features; residuals: |C v - value v| of each vector.

    vectors: (j, component, v); projections: (i, component, v), of the centred rows.
    """

    values: list[float]
    total: float
    residuals: list[float]
    vectors: DataFrame
    projections: DataFrame

    def table(self) -> DataFrame:
        """component, value, ratio (share of the total variance), residual."""
        rows = [(c, v, v / self.total if self.total else None, r) for c, (v, r) in enumerate(zip(self.values, self.residuals, strict=True))]
        return self.vectors.sparkSession.createDataFrame(rows, "component int, value double, ratio double, residual double")


#: A block grows to so many times its size.
GROWN = 5
#: Columns of a table whose rows are records, at most.
NARROW = 1024


def _projected(rows: DataFrame, vectors: DataFrame, size: int, back: bool) -> DataFrame:
    """The centred rows (i, j and v arrays) times the vectors: i, y; with ``back`` these times the rows again, added up: j, z."""
    told = sorted(vectors.select("j", "mean", "x").collect(), key=lambda r: r.j)  # NARROW rows at most
    names, x = np.array([r.j for r in told]), np.array([r.x for r in told], float).reshape(-1, size)
    offset = np.array([r.mean for r in told]) @ x
    number, kind = rows.schema["i"].dataType.simpleString(), vectors.schema["j"].dataType.simpleString()

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for whole in it:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                dense = np.zeros((batch.num_rows, len(names)))
                lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                at = np.searchsorted(names, batch.column("j").flatten().to_numpy(zero_copy_only=False))
                np.add.at(dense, (np.repeat(np.arange(batch.num_rows), lengths), at), batch.column("v").flatten().to_numpy(zero_copy_only=False))
                yield batch.column("i"), dense, dense @ x - offset

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * size, pa.int32()), pa.array(a.ravel()))

    def forth(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, _, y in parts(it):
            yield pa.RecordBatch.from_arrays([i, lists(y)], ["i", "y"])

    def forth_and_back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = sum((dense.T @ y for _, dense, y in parts(it)), np.zeros((len(names), size)))
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), {"int": pa.int32(), "smallint": pa.int16()}.get(kind)), lists(z)], ["j", "z"])

    if not back:
        return rows.mapInArrow(forth, f"i {number}, y array<double>")
    sums = rows.where("i is not null").mapInArrow(forth_and_back, f"j {kind}, z array<double>")
    return sums.groupBy("j").agg(F.array(*(F.sum(F.col("z")[b]) for b in range(size))).alias("z"))


def _centred_rows(cells: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """i, y (array): the centred rows times the vectors of ``vectors`` (j, mean, x array of ``size``). cells: cells, or rows as records."""
    if isinstance(cells.schema["v"].dataType, ArrayType):
        return _projected(cells, vectors, size, back=False)
    offset = vectors.agg(*(F.sum(F.col("mean") * F.col("x")[b]) for b in range(size))).first()  # a number for each vector
    sums = cells.join(vectors.select("j", "x"), "j").groupBy("i").agg(*(F.sum(F.col("v") * F.col("x")[b]).alias(f"y{b}") for b in range(size)))
    return sums.select("i", F.array(*(F.col(f"y{b}") - float(offset[b]) for b in range(size))).alias("y"))


def _applied(cells: DataFrame, vectors: DataFrame, size: int, n: int) -> DataFrame:
    """j, z (array): the covariance applied to the vectors. The centred rows add up to 0, so means need no second term."""
    if isinstance(cells.schema["v"].dataType, ArrayType):
        z = _projected(cells, vectors, size, back=True)
        return z.select("j", F.transform("z", lambda v: v / max(n - 1, 1)).alias("z"))
    y = _centred_rows(cells, vectors, size)
    sums = cells.join(y, "i").groupBy("j").agg(*((F.sum(F.col("v") * F.col("y")[b]) / max(n - 1, 1)).alias(f"z{b}") for b in range(size)))
    return sums.select("j", F.array(*(f"z{b}" for b in range(size))).alias("z"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _turned(table: DataFrame, turns: dict[str, np.ndarray]) -> DataFrame:
    """j, mean and, for each name of ``turns``, an array: the numbers of v and w of each row times a matrix."""
    kind = table.schema["j"].dataType.simpleString()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                both = np.concatenate([_matrix(batch, "v"), _matrix(batch, "w")], axis=1)
                out = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * t.shape[1], pa.int32()), pa.array((both @ t).ravel())) for t in turns.values()]
                yield pa.RecordBatch.from_arrays([batch.column("j"), batch.column("mean"), *out], ["j", "mean", *turns])

    return table.mapInArrow(rows, f"j {kind}, mean double, " + ", ".join(f"{t} array<double>" for t in turns))


def _products(table: DataFrame, size: int) -> np.ndarray:
    """Products of all vectors v and w of the block with each other, added up over tasks by Spark."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * size, 2 * size))
        for batch in it:
            if batch.num_rows:
                both = np.concatenate([_matrix(batch, "v"), _matrix(batch, "w")], axis=1)
                total += both.T @ both
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "p"])

    found = table.select("v", "w").mapInArrow(rows, "at long, p double").groupBy("at").agg(F.sum("p").alias("p")).collect()  # (2 size)^2 numbers
    out = np.zeros(4 * size * size)
    for r in found:
        out[r.at] = r.p
    return out.reshape(2 * size, 2 * size)


def _root(gram: np.ndarray, least: float) -> np.ndarray:
    """Weights that turn vectors with these products into orthonormal ones; directions that have all but vanished are left out."""
    size, turn = np.linalg.eigh((gram + gram.T) / 2)
    kept = size > least
    return turn[:, kept] / np.sqrt(size[kept])


def principal_components(cells: DataFrame, k: int, extra: int = 8, tolerance: float = 1e-7, rounds: int = 60, seed: int = 7) -> Components:
    """The k largest components (M-10, M-11). ``extra`` further vectors speed up convergence; a component has sign + where its entry is largest.

    Rounds end when residuals are below ``tolerance`` of the largest value; a warning tells where ``rounds`` were not enough.
    Null values count as 0, as absent cells do. An empty table has no components.
    """
    cells = materialise(cells.where("v is not null").select("i", "j", F.col("v").cast("double").alias("v")), "cells")
    n = cells.agg(F.count_distinct("i")).first()[0]
    columns = cells.groupBy("j").agg((F.sum("v") / max(n, 1)).alias("mean"), F.sum(F.col("v") * F.col("v")).alias("square"))
    d, total = columns.agg(F.count("*"), F.sum(F.col("square") - n * F.col("mean") * F.col("mean"))).first()
    k, step = min(k, d), min(k + extra, d)
    if not k:
        empty = cells.where("false")
        return Components([], 0.0, [], empty.select("j", F.lit(0).alias("component"), "v"), empty.select("i", F.lit(0).alias("component"), "v"))
    if d <= NARROW:
        cells = materialise(cells.where("j is not null").groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("c")).select("i", F.col("c.j").alias("j"), F.col("c.v").alias("v")), "rows")
    start = F.array(*(F.xxhash64(F.lit(seed), F.lit(b), "j") / float(2**63) for b in range(step)))
    new = materialise(columns.select("j", "mean", start.alias("x")), "block")
    table, size = materialise(new.join(_applied(cells, new, step, n), "j").select("j", "mean", F.col("x").alias("v"), F.col("z").alias("w")), "block"), step
    scale = max(float(total or 0.0), 1e-300) / max(n - 1, 1)
    for again in range(rounds):
        products = _products(table, size)
        vv, vw, ww = products[:size, :size], products[:size, size:], products[size:, size:]
        root = _root(vv, vv.trace() * 1e-14)
        small, turn = np.linalg.eigh(root.T @ (vw + vw.T) / 2 @ root)
        order = np.argsort(-small)[:step]
        values, best = small[order], root @ turn[:, order]
        residuals = np.sqrt(np.maximum(np.einsum("ab,ac,cb->b", best, ww, best) - values**2, 0))
        if residuals[:k].max() <= tolerance * max(values[0], scale * 1e-12) or again == rounds - 1:
            break
        left = np.concatenate([-best * values, best])  # residuals as weights of v and w
        left[:size] -= root @ (root.T @ (products[:size] @ left))  # orthogonal to the block
        left = left @ _root(left.T @ products @ left, max(values[0], scale * 1e-12) ** 2 * 1e-20)
        if not left.shape[1]:
            break
        if size + left.shape[1] > GROWN * step:  # the best vectors stay
            keep = best
        else:
            keep = np.eye(size)
        none = np.zeros_like(keep)
        turned = _turned(table, {"x": left, "v": np.concatenate([keep, none]), "w": np.concatenate([none, keep])})
        turned = materialise(turned, "block")
        grown = turned.join(_applied(cells, turned.select("j", "mean", "x"), left.shape[1], n), "j")
        table, size = materialise(grown.select("j", "mean", F.concat("v", "x").alias("v"), F.concat("w", "z").alias("w")), "block"), keep.shape[1] + left.shape[1]
    if residuals[:k].max() > tolerance * max(values[0], scale * 1e-12):
        warnings.warn(f"components have residuals of {residuals[:k].max():.2g} after {rounds} rounds", stacklevel=2)
    k = min(k, len(values))
    found = materialise(_turned(table, {"x": np.concatenate([best[:, :k], np.zeros((size, k))])}), "components")
    largest = found.agg(*(F.max_by(F.col("x")[c], F.struct(F.round(F.abs(F.col("x")[c]), 9), F.col("j"))) for c in range(k))).first()
    signed = found.select("j", "mean", F.array(*(F.col("x")[c] * (1.0 if largest[c] >= 0 else -1.0) for c in range(k))).alias("x"))
    rows = _centred_rows(cells, signed, k)
    long = lambda t, key, name: t.select(key, F.posexplode(name).alias("component", "v"))
    return Components(values[:k].tolist(), float(total) / max(n - 1, 1), residuals[:k].tolist(), long(signed, "j", "x"), long(rows, "i", "y"))


def half_cosines(components: Components, half: int) -> DataFrame:
    """component, cosine between a vector's entries at j and at j + half: wild-type and mutant halves of tracks side by side (M-12)."""
    pairs = components.vectors.groupBy("component", (F.col("j") % half).alias("_p")).agg(*(F.sum(F.when((F.col("j") >= half) == late, F.col("v")).otherwise(0.0)).alias(n) for n, late in (("_a", False), ("_b", True))))
    norm = F.sqrt(F.sum(F.col("_a") ** 2)) * F.sqrt(F.sum(F.col("_b") ** 2))
    return pairs.groupBy("component").agg((F.sum(F.col("_a") * F.col("_b")) / F.greatest(norm, F.lit(1e-8))).alias("cosine"))
