"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary words and identifiers: all values that the patterns find in
all documents labelled as good and seeded random strings against all words of the same documents and identifiers joined
from them. One word in five, by its hash, is held back with the identifiers joined from such words. A
token is reported when its mean log-likelihood ratio is above a threshold that lets through none of those held back; one
that a pattern covers in part is reported whole, or else those of its parts outside that are tokens and look random.

Defined cases: null and empty texts have no spans, and the digest of the empty string. Rows with a null id, repeated rows
and extra columns are scanned alike. An empty table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import map_texts, materialise, of_keys, text_batches
from varsparq.storage import discard

#: The patterns of the base and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_WORD = re.compile(r"[A-Za-z]{4,}")
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SIZE = len(ALPHABET) + 1


def _transitions(strings: list[str]) -> np.ndarray:
    """How often each character of ALPHABET follows each other within ``strings``."""
    code = _CODE[np.frombuffer("\n".join(strings).encode(), np.uint8)]
    counts = np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    counts[-1, :] = counts[:, -1] = 0
    return counts


class MarkovPair:
    """Log-likelihood ratio of character transitions, random strings over ordinary ones."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray) -> None:
        tables = []
        for seen in (random_counts, ordinary_counts):
            counts = seen + 0.5
            tables.append(np.log(counts / counts.sum(1, keepdims=True)))
        self.ratio = tables[0] - tables[1]
        self.threshold = 0.0

    def score(self, token: str) -> float:
        code = _CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].mean())

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tokens, or parts of them, that look random and aren't within base spans."""
        out = []
        for m in TOKEN.finditer(text):
            outside, at = [], m.start()  # parts outside base spans
            for a, _, b in base:
                if b > at and a < m.end():
                    if a > at:
                        outside.append((at, a))
                    at = b
            if at < m.end():
                outside.append((at, m.end()))
            if not outside:
                continue
            if self.score(m[0]) > self.threshold:
                out.append((m.start(), 3, m.end()))
            elif outside != [m.span()]:
                out += [(a, 3, b) for a, b in outside if TOKEN.fullmatch(text, a, b) and self.score(text[a:b]) > self.threshold]
        return out


def _identifiers(words: list[str], draw: random.Random, n: int) -> list[str]:
    """Ordinary identifiers: words joined in the usual ways, some with a short number."""
    out = []
    for _ in range(n):
        some = [draw.choice(words) for _ in range(draw.randint(2, 4))]
        name = draw.choice(["_".join(some), "-".join(some), "/".join(some), some[0] + "".join(w.capitalize() for w in some[1:])])
        out.append(name + draw.choice(["", str(draw.randint(0, 9)), f"_{draw.randint(10, 2099)}", f"-v{draw.randint(1, 9)}"]))
    return out


def _held(word: str) -> bool:
    return zlib.crc32(word.encode()) % 5 == 0


def _words(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The distinct words of a text outside of ``spans``."""
    parts, at = [], 0
    for a, _, b in spans:
        parts.append(text[at : max(a, at)])
        at = max(at, b)
    return sorted(set(_WORD.findall(" ".join([*parts, text[at:]]))))


def fit(docs: DataFrame, labels: DataFrame, strings: int = 6_000, seed: int = 7) -> MarkovPair:
    """Train on all documents with a label of quality 1, and on ``strings`` random strings."""
    good = labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()
    texts = materialise(of_keys(docs.select("doc_id", "text").where("text is not null"), "doc_id", good), "labelled")

    def identifiers(text: str, words: list[str]) -> list[str]:
        return _identifiers(words, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + seed), len(words)) if words else []

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ordinary, values = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text)
            found = {text[a:b] if k else text[a:b].split("=")[-1].split(":")[-1].strip(" \"'") for a, k, b in spans}
            values += [v for v in found if len(v) >= 8 and v.isascii()]
            words = [w for w in _words(text, spans) if not _held(w)]
            ordinary += words + identifiers(text, words)
        counts = np.concatenate([_transitions(values).ravel(), _transitions(ordinary).ravel()])
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "n"])

    seen = np.zeros(2 * SIZE * SIZE, np.int64)
    for r in map_texts(texts, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2 * SIZE ** 2 rows
        seen[r.at] = r.n
    found, ordinary = seen.reshape(2, SIZE, SIZE)
    draw = random.Random(seed)
    kinds = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.hexdigits[:16], ALPHABET]
    made = ["".join(draw.choices(draw.choice(kinds), k=draw.randint(16, 48))) for _ in range(strings)]
    spare = ["name", "value", "index", "count"]
    if not ordinary.any():
        ordinary = _transitions(_identifiers(spare, draw, strings) + spare)
    model = MarkovPair(_transitions(made) + found, ordinary)

    def highest(batch: pa.RecordBatch) -> pa.RecordBatch:
        top = []
        for text in batch.column(1).to_pylist():
            words = [w for w in _words(text, base_spans(text)) if _held(w)]
            top.append(max((model.score(x) for x in words + identifiers(text, words) if len(x) >= 16), default=None))
        return pa.RecordBatch.from_arrays([pa.array(top, pa.float64())], ["top"])

    top = map_texts(texts, highest, "top double").agg(F.max("top")).first()[0]
    discard(texts)
    if top is None:
        top = max(model.score(x) for x in _identifiers(spare, draw, strings) if len(x) >= 16)
    model.threshold = max(0.0, top)
    return model


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of each row of ``docs``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = model.spans(text or "", base)
            count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            out.append((*count, hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + more)), len(more)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def secret_scan(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Spans of secrets in every whole text; see scan()."""
    return scan(docs, fit(docs, labels, **options))


def redacted(docs: DataFrame, labels: DataFrame, mark: str = "<secret>", **options: int) -> DataFrame:
    """``docs`` with each span of a secret replaced by ``mark`` (overlapping spans by one) and n_chars set anew for changed texts."""
    model = fit(docs, labels, **options)
    text_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202  pandas series
        def one(text: str | None) -> str | None:
            if not text:
                return text
            base = base_spans(text)
            out, at = [], 0
            for a, _, b in sorted(base + model.spans(text, base)):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    old = docs.withColumn("_clean", clean("text"))
    changed = ~F.col("_clean").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.char_length("_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return old.withColumns({"n_chars": n_chars, "text": F.col("_clean")}).select(*docs.columns)
