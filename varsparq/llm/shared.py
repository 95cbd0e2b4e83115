"""What the operators of this package share: the shared folder, intermediate tables, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.llm.tokens import forget
from varsparq.storage import materialise, shared_folder, table_path

__all__ = ["gathered", "map_texts", "materialise", "of_keys", "shared_folder", "table_path", "text_batches"]

#: Rows of an Arrow batch that carries texts: a batch of very long texts still fits in a Python worker.
TEXT_BATCH_ROWS = 256
#: Bytes of Arrow batches that are encoded at once, about.
ENCODED_BYTES = 4 << 20
#: Bits that of_keys broadcasts (4 MB), however many keys there are.
KEY_BITS = 1 << 25


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ENCODED_BYTES with the rows of ``it`` in their order, none of them empty; a larger batch stays alone."""
    held, size = [], 0
    for batch in it:
        if held and size + batch.nbytes > ENCODED_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, encodes: bool = False) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df`` in the executors, gathered where it ``encodes``; else encoders of earlier tasks are dropped."""
    text_batches(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget()
        for batch in gathered(it) if encodes else it:
            if batch.num_rows:
                yield rows(batch)

    return df.mapInArrow(batches, schema)


def of_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` joined to ``keys`` (rows with distinct ``key``), dealt by key at every size.

    Rows whose hash no key has are left out before the shuffle, by a table of KEY_BITS bits: it only spares shuffled
    rows, as the join tells which are really of a key. With more keys than bits it spares none.
    """
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1
    bits = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    met = df.withColumn("_place", place).join(F.broadcast(bits), F.bitmap_bucket_number("_place") == F.col("_bucket")).where(_bit(F.col("_bits"), F.bitmap_bit_position("_place")))
    return met.select(*df.columns).join(keys.hint("merge"), key)


def _bit(bits: Column, at: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg has a bit."""
    byte = F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
