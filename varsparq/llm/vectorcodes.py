"""Codes of vectors by product quantisation in whole numbers: the same codes on every machine and in every order of rows.

A vector's components become floor(scale * x) and are cut into equal parts. The codebooks of all parts (``entries`` rows of
a part's length each, so parts * entries * length numbers, whatever the table's size) are broadcast in each round. Tasks
take all distances of an Arrow batch by |x - b|^2 = |x|^2 - 2 x.b + |b|^2 with 64-bit integer products and keep the first
nearest entry. Each task gives one row of sums for each entry in use; a grouped shuffle adds these up, and only the merged
entries come to the driver.

Defined cases: vectors that are null or hold null or non-finite components take no part. Vectors
of a length that can't be cut into equal parts take no part either; nor do those whose length isn't that of the smallest id
left. Rows with a null id are coded and come last in the order of ids; rows with equal ids are in the order
of their numbers. Repeated rows are coded alike and count each. With fewer rows than entries the codebooks are shorter. A
component that is so large that sums of squares could leave 64 bits raises an error. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise

#: Vectors whose distances to all entries are held at once.
ROWS = 2048
#: A hot label's rows meet its sum in so many places.
SALTS = 32


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: the rows that take part, components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.sqrt(F.lit(2.0**60) / F.size("v"))  # then 4 * size * most^2 stays below 2^63

    def fitting(c):
        scaled = F.floor(c * scale)
        return F.when(F.abs(c) * scale <= most, scaled.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit sums of squares")).cast("int"))

    kept = vectors.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", "label", x.alias("v"))
    return kept.withColumn("v", F.transform("v", fitting))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of a codebook, exact in 64 bits."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row and part, ties to the lower entry; books: parts x entries x length."""
    parts, _, width = books.shape
    near, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for at in range(0, len(x), ROWS):
        for p in range(parts):
            d = distances(x[at : at + ROWS, p * width : (p + 1) * width], books[p])
            near[at : at + ROWS, p] = d.argmin(1)
            far[at : at + ROWS, p] = d.min(1)
    return near, far


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return v.reshape(batch.num_rows, -1)


def _entry_sums(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and the sums s0, s1, ... of the parts assigned to each entry in use."""
    shared = numbers.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in it:
            if batch.num_rows:
                x = _rows_of(batch)
                near, _ = assign(x, shared.value)
                for p in range(parts):
                    order = np.argsort(near[:, p], kind="stable")
                    used, first, n = np.unique(near[order, p], return_index=True, return_counts=True)
                    total[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                    count[p, used] += n
        p, e = np.nonzero(count)
        values = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *(pa.array(total[p, e, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(values, ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = [f"s{i}" for i in range(width)]
    found = numbers.select("v").mapInArrow(sums, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))


def _next_books(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by floor(sum / count) of their parts; entries not in use stay."""
    means = F.array(*(F.expr(f"(s{i} - pmod(s{i}, n)) div n") for i in range(books.shape[2])))
    new = books.copy()
    for row in _entry_sums(numbers, books).select("part", "entry", means.alias("mean")).collect():  # parts x entries rows at most
        new[row.part, row.entry] = row.mean
    return new


def fit_books(numbers: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks (parts x entries x length) after the rounds; None without a row that can be cut."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = numbers.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).limit(1).collect()
    if not first:
        return None
    size = len(first[0].v)
    rows = numbers.where(F.size("v") == size)
    start = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _next_books(rows, books)
    return books


def encode(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error (squared distances summed over parts) of the vectors of the codebooks' length."""
    shared = numbers.sparkSession.sparkContext.broadcast(books)
    kind = numbers.schema["vec_id"].dataType.simpleString()
    label = numbers.schema["label"].dataType.simpleString()
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))

    def codes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                near, far = assign(_rows_of(batch), shared.value)
                text = ["".join(f"{e:0{digits}x}" for e in row) for row in near.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    rows = numbers.where(F.size("v") == parts * width).select("vec_id", "label", "v")
    return rows.mapInArrow(codes, f"vec_id {kind}, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together). A hot label is summed in parts and met in SALTS places."""
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_at"))
    salted = coded.withColumn("_salt", salt)
    return salted.join(sums, (F.col("_salt") == F.col("_at")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_salt", "_at", "_label")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code (hex digits of each part's entry), error, label_error and codebooks_sha256 of each vector that takes part."""
    numbers = materialise(whole_numbers(vectors, scale), "numbers")
    books = fit_books(numbers, parts, entries, rounds)
    if books is None:
        return numbers.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialise(encode(numbers, books), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
