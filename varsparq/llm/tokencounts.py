"""Token counts with a cache: a text is encoded once for each version of a tokenizer, however often it comes.

The cache is a Parquet table (tokenizer, digest, n_tokens), partitioned by tokenizer, in any store that Spark reads.
``tokenizer`` is a digest of the vocabulary file and of the library's version, ``digest`` the SHA-256 of the normalised
text. The tokenizers used here tell any two texts apart, so normalising does no more than to read null as an empty text; a
caller whose tokenizer ignores, say, case gives a column expression of its own that never changes a count.

A run takes the digests of all texts, looks for them in the cache, encodes each missing text once and appends the counts.
Where nothing is missing, no text is shuffled or encoded. Texts with equal digests are thinned in the tasks that read them
before they are shuffled, so copies of one text never gather in a task. Digests of more than a thousandth of all rows, a
thousand at most, meet their rows by broadcast; all others by a shuffle in which no key has more rows than that.

Defined cases: a null text is empty and has 0 tokens. A very long text is encoded whole, in one task. Rows with null or
equal ids are counted each. A cache that holds a digest twice (two runs at once) is read as if it held it once. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsparq.llm.shared import map_texts, materialise, table_path
from varsparq.llm.tokens import collector_off, encoder

#: A digest of more than one in so many rows is hot.
HOT_SHARE = 1000
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def library_of(vocabulary: str) -> str:
    """The library that reads a vocabulary file, by its ending."""
    libraries = {".json": "tokenizers", ".model": "sentencepiece"}
    ending = Path(vocabulary).suffix
    if ending not in libraries:
        raise ValueError(f"no tokenizer library for {ending or vocabulary} files")
    return libraries[ending]


def tokenizer_digest(vocabulary: str) -> str:
    """SHA-256 of the vocabulary file, the library and its version: counts of another version are never used."""
    library = library_of(vocabulary)
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + Path(vocabulary).read_bytes()).hexdigest()


def counter(vocabulary: str) -> Callable[[str], int]:
    """Tokens of a whole text by the vocabulary's library, without special tokens added, in this Python process."""
    if library_of(vocabulary) == "tokenizers":
        encode = encoder(vocabulary).encode
        return lambda text: len(encode(text)) // 4
    model = _pieces(vocabulary)
    return lambda text: len(model.encode(text))


@lru_cache
def _pieces(vocabulary: str) -> object:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary)


def whole_text(text: Column) -> Column:
    """The normal form of a text for tokenizers that tell any two texts apart."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer; empty where the cache does not exist yet."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_missing(texts: DataFrame, missing: DataFrame, vocabulary: str) -> DataFrame:
    """digest, n_tokens of the texts (digest, text) whose digest is missing, each encoded once."""
    distinct = texts.groupBy("digest").agg(F.any_value("text").alias("text"))  # thinned before the shuffle
    todo = distinct.join(missing.select("digest"), "digest", "left_semi")

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(vocabulary)
        with collector_off():
            n = [count(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return map_texts(todo.select("digest", "text"), counts, "digest binary, n_tokens long", encodes=True)


def fill_cache(texts: DataFrame, groups: DataFrame, vocabulary: str, path: str) -> int:
    """Append the counts of all digests of ``groups`` that the cache lacks; gives their number."""
    spark, tokenizer = texts.sparkSession, tokenizer_digest(vocabulary)
    missing = materialise(groups.select("digest").join(read_cache(spark, path, tokenizer), "digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        found = count_missing(texts, missing, vocabulary)
        found.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(path)
    return n


def by_digest(rows: DataFrame, groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (digest, ...) with their n_tokens; ``groups`` has the rows of each digest as n."""
    total = groups.agg(F.sum("n")).first()[0] or 0  # one number
    hot = groups.where(F.col("n") > total // HOT_SHARE + 1).select("digest")  # fewer than HOT_SHARE digests
    few = F.broadcast(hot.join(counts, "digest"))
    return rows.join(few, "digest").unionByName(rows.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest"))


def token_counts(docs: DataFrame, vocabulary: str, limit: int, cache: str | None = None, normal: Callable[[Column], Column] = whole_text) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text of ``docs`` (doc_id, text).

    ``cache`` is the path of a cache to use and to fill; without one a new cache serves this call only.
    """
    spark = docs.sparkSession
    path = cache or table_path(spark, "token-counts")
    text = normal(F.col("text"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = materialise(docs.select("doc_id", digest.alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "digests")
    groups = materialise(rows.groupBy("digest").agg(F.count("*").alias("n")), "texts")
    fill_cache(docs.select(digest.alias("digest"), text.alias("text")), groups, vocabulary, path)
    counted = by_digest(rows, groups, read_cache(spark, path, tokenizer_digest(vocabulary)))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
