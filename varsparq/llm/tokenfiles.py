"""Token ids in word-aligned Simple-8b files, written and read by Spark.

A selector in the lowest 4 bits of a 64-bit little-endian word says how many ids of how many bits the other 60 hold:
SELECTORS[s] = (ids, bits). Selector 15 is an escape: the next word is one id of up to 64 bits. Ids are coded in blocks
of BLOCK ids; the offset of each block, in words, lets a reader decode blocks on their own, all words of a selector at once.

A file set is a Parquet folder: one row is one self-contained chunk of documents in rising order of doc_id, with the bytes
of ``encode_chunk`` in the column data, so files are written by Spark's committers to any store and survive lost executors.

Defined cases: a null or empty text holds the end id alone. Rows with a null id come first; rows with equal ids are in the
order of their texts. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.llm.shared import gathered, materialise, table_path, text_batches
from varsparq.llm.tokens import collector_off, encoder

#: Fixed values of the format: (ids of a word, bits of an id) by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE, MAGIC, BLOCK = 15, b"VSQ8", 4096
#: Documents and ids of a chunk, at most (a longer document is a chunk of its own).
CHUNK_DOCS, CHUNK_IDS = 2000, 2_000_000


def _all_ahead(good: np.ndarray, count: int) -> np.ndarray:
    """Whether ``count`` values from each place on are good; shorter by count - 1."""
    done, width = good, 1
    while width < count:
        more = min(width, count - width)
        done, width = done[: len(done) - more] & done[more:], width + more
    return done


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, offset of each block in words and their end); no word holds ids of two blocks."""
    n = len(ids)
    left = block - np.arange(n, dtype=np.int32) % block  # ids to the end of the block
    choice = np.full(n, ESCAPE, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        if count > n:
            continue
        fits = _all_ahead(ids < (1 << width), count)
        if not fits.any():  # then no longer run of narrower ids fits either
            break
        choice[: len(fits)][fits & (left[: len(fits)] >= count)] = s
    step = np.array([c for c, _ in SELECTORS] + [1], np.uint8)[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    words[place] = chosen
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s) if width else ()
        if len(own):
            at, word = starts[own], words[place[own]]
            for k in range(count):
                word |= ids[at + k].astype(np.uint64) << np.uint64(4 + k * width)
            words[place[own]] = word
    words[place[escaped] + 1] = ids[starts[escaped]]
    firsts = place[np.searchsorted(starts, np.arange(0, n, block))]
    return words, np.append(firsts, len(words))


def encode_block(ids: np.ndarray) -> np.ndarray:
    """64-bit words of one block of ids."""
    return encode_ids(ids, max(len(ids), 1))[0]


def decode_block(words: np.ndarray) -> np.ndarray:
    """Ids of the words of one block, or of several in a row."""
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that follow an escape
    at = 0
    escapes = np.flatnonzero(selector == ESCAPE)
    for e in escapes.tolist():
        if e >= at and not raw[e]:
            raw[e + 1] = True
            at = e + 2
    head = ~raw
    count = np.array([c for c, _ in SELECTORS] + [1])[selector] * head
    start = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint64)
    for s, (n, width) in enumerate(SELECTORS):
        own = head & (selector == s)
        if width and own.any():
            at, word, mask = start[own], words[own], np.uint64((1 << width) - 1)
            for k in range(n):
                ids[at + k] = (word >> np.uint64(4 + k * width)) & mask
    own = np.flatnonzero(head & (selector == ESCAPE))
    ids[start[own]] = words[own + 1]
    return ids


def encode_chunk(docs: list[bytes]) -> bytes:
    """A chunk: MAGIC, documents, blocks, ids of each document, offsets of blocks (words), words, crc32 of all before."""
    words, offsets = encode_ids(np.frombuffer(b"".join(docs), "<u4"))
    sizes = np.array([len(d) // 4 for d in docs], "<u8")
    body = b"".join([MAGIC, struct.pack("<IQ", len(docs), len(offsets) - 1), sizes.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, all ids) of a chunk; raises ValueError when its bytes are damaged."""
    if data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole chunk of token ids")
    n, blocks = struct.unpack_from("<IQ", data, 4)
    sizes = np.frombuffer(data, "<u8", n, 16)
    offsets = np.frombuffer(data, "<u8", blocks + 1, 16 + 8 * n).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), 16 + 8 * (n + blocks + 1))
    return sizes.astype(np.int64), decode_block(words)  # blocks follow each other without a gap


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, partitions: int | None = None) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text) to ``path`` in rising order of doc_id."""
    spark = docs.sparkSession
    text_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode_all, np.array([end_id], "<u4").tobytes()
        chunk, held, doc_ids, number, total = [], 0, [], 0, 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary()]
            values = [part], [number], [total], [doc_ids], [encode_chunk(chunk)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "chunk", "start", "doc_ids", "data"])

        part, kind = 0, pa.int64()
        for batch in gathered(it):
            kind = batch.schema.field(0).type
            with collector_off():
                encoded = encode(batch.column("text"))
            for doc, ids, part in zip(batch.column("doc_id").to_pylist(), encoded, batch.column("part").to_pylist(), strict=True):
                ids += end
                if chunk and (len(chunk) >= CHUNK_DOCS or held + len(ids) // 4 > CHUNK_IDS):
                    yield out()
                    number, total, chunk, held, doc_ids = number + 1, total + held, [], 0, []
                chunk.append(ids)
                doc_ids.append(doc)
                held += len(ids) // 4
        if chunk:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(chunks, f"part int, chunk long, start long, doc_ids array<{kind}>, data binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, read back from the files.

    Only the number of ids of each part is gathered, one number for each partition of the writer.
    """
    text_batches(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, start, doc_ids, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "doc_ids", "data")), strict=True):
                sizes, ids = decode_chunk(data)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, batch.schema.field("doc_ids").type.value_type), pa.array([part] * len(sizes), pa.int32()), pa.array(ends - sizes + start), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    read = materialise(files.mapInArrow(rows, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long"), "tokens")
    totals = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = {r.part: r.n for r in totals.collect()}
    at, firsts = 0, []
    for part in sorted(before):
        firsts.append((part, at))
        at += before[part]
    first = spark.createDataFrame(firsts, "part int, first long")
    return read.join(F.broadcast(first), "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back; see read_token_files()."""
    path = table_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
