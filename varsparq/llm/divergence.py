"""How far the sources of a language differ in their words: pairs of sources, and the terms that mark a source.

Each task counts the terms of its documents by source, in columns of numbers, and sets up a radix trie over UTF-8 bytes for
each language, whose leaves have a counter for each source and the number of documents that hold the term. When a language
has LEAVES terms its trie is handed on and a new one begun: tries merge, so where one ends doesn't matter. Leaves are dealt
by ranges of (language, term); a range arrives in the order of a walk through its merged trie, so merging adds up
neighbours: of a stretch, those in too few documents go first. Kept leaves travel in blocks of BLOCK, each a stretch of
that walk.

A block gives its share of every pair of sources, and candidates for the terms of each source in the order of the result
(value falling, then bytes rising), of which a task hands on ``ranks`` for each source. Sources come in tiles of TILE;
pairs of tiles meet blocks by a join on language that Spark plans by the tiles' size. Shares are plain integers.

Defined cases: null text, language or source is empty text. A source without terms, and a language without kept terms, has
its pairs (with value 0 in the latter). Each row is a document, repeated ones too. Very long texts are counted whole. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise, text_batches
from varsparq.llm.tokens import collector_off

#: Leaves of a trie that is handed on, of a batch of rows, of a block, sources of a tile, and leaves that are merged at once.
LEAVES, LEAF_ROWS, BLOCK, TILE, ROWS = 300_000, 10_000, 1024, 256, 50_000
#: Letters, A-Z lower-cased, and all bytes above ASCII; all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
ONE = 10**9


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def radix_trie(terms: list[bytes]) -> list:
    """The trie of sorted distinct byte strings: a node is [edges by first byte, place in ``terms`` or None], an edge (bytes, node)."""
    root: list = [{}, None]
    path, before = [(0, root)], b""  # nodes from the root to the last leaf, with their depths
    for k, term in enumerate(terms):
        same = _common(before, term)
        while path[-1][0] > same:
            path.pop()
        depth, node = path[-1]
        if depth < same:  # the edge to the last leaf parts here
            label, below = node[0][before[depth]]
            middle: list = [{label[same - depth]: (label[same - depth :], below)}, None]
            node[0][before[depth]] = (label[: same - depth], middle)
            path.append((same, middle))
            node = middle
        leaf: list = [{}, k]
        if same == len(term):  # only the empty string, at the root
            node[1] = k
        else:
            node[0][term[same]] = (term[same:], leaf)
            path.append((len(term), leaf))
        before = term
    return root


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def walk(root: list) -> Iterator[tuple[bytes, int]]:
    """Terms and places of a trie, in the order of bytes: a term before those that it begins, edges as they came, which is sorted."""
    stack = [(b"", root)]
    while stack:
        term, node = stack.pop()
        if node[1] is not None:
            yield term, node[1]
        stack += [(term + label, below) for label, below in reversed(node[0].values())]


class Counts:
    """Occurrences and documents of the terms of one language, by source, as columns of numbers."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = _Numbers()
        self.sources: dict[str, int] = _Numbers()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # term << 32 | source, occurrences, documents
        self.size = self.settled = 0

    def add(self, source: str, found: list[bytes]) -> None:
        number = self.sources[source]
        if found:
            ids, n = np.unique(np.fromiter(map(self.terms.__getitem__, found), np.int64, len(found)), return_counts=True)
            self.parts.append((ids << 32 | number, n, np.ones(len(ids), np.int64)))
            self.size += len(ids)
            if self.size > 2 * self.settled + LEAVES:
                self.settle()

    def settle(self) -> None:
        """Add up rows of the same term and source."""
        if self.parts:
            key, *values = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.parts = [(key[firsts], *(np.add.reduceat(v[order], firsts) for v in values))]
            self.size = self.settled = len(firsts)

    def leaves(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The leaves of the language's trie as rows, in the order of bytes."""
        if not self.parts:
            return
        self.settle()
        key, n, docs = self.parts[0]
        term, source = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        firsts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        docs = np.add.reduceat(docs, firsts[:-1])
        with collector_off():
            ordered = sorted(self.terms)
            steps = iter(list(walk(radix_trie(ordered))))
        numbers = np.fromiter(map(self.terms.__getitem__, ordered), np.int64, len(ordered))
        names = pa.array(list(self.sources), pa.string())
        while some := list(islice(steps, LEAF_ROWS)):
            own = numbers[[k for _, k in some]]
            sizes = firsts[own + 1] - firsts[own]
            ends = np.concatenate([[0], sizes.cumsum()])
            at = np.repeat(firsts[own] - ends[:-1], sizes) + np.arange(ends[-1])
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (names.take(pa.array(source[at])), pa.array(n[at])))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([t for t, _ in some], pa.binary()), pa.array(docs[own]), *lists], schema=_LEAF)


class _Numbers(dict):
    """Keys to numbers in the order in which they come."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"


def count_terms(docs: DataFrame) -> DataFrame:
    """Leaves of the tries of all tasks (lang, term, docs, sources, counts), and a row with a null term for the sources of a language."""
    text_batches(docs.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counts] = {}
        seen: dict[str, set[str]] = {}
        for batch in it:
            with collector_off():  # there are no cycles to find among so many terms
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if lang not in counts:
                        counts[lang] = Counts()
                    counts[lang].add(source, terms_of(text))
                    seen.setdefault(lang, set()).add(source)
            for lang in [k for k, c in counts.items() if len(c.terms) >= LEAVES]:
                yield from counts.pop(lang).leaves(lang)
        for lang, own in counts.items():
            yield from own.leaves(lang)
        for lang, sources in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((lang, None, 0, sorted(sources), []), _LEAF, strict=True)], schema=_LEAF)

    empty = F.lit("")
    return docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source")), F.coalesce("text", empty).cast("binary").alias("text")).mapInArrow(count, _LEAF_DDL)


_BLOCK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_BLOCK_DDL = "lang string, terms array<binary>, ends array<int>, sources array<string>, counts array<long>"


def _starts(table: pa.Table) -> np.ndarray:
    """The first row of each (lang, term) of sorted leaves."""
    lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
    new = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _frequent(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows of sorted leaves whose (lang, term) is in at least ``least`` documents; the last term of a stretch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def kept(table: pa.Table, whole: bool) -> tuple[pa.Table, pa.Table]:
        firsts = _starts(table)
        total = np.add.reduceat(table.column("docs").to_numpy(), firsts)
        good = np.repeat(total >= least, np.diff(np.append(firsts, table.num_rows)))
        last = table.num_rows if whole else int(firsts[-1])
        good[last:] = False
        return table.filter(pa.array(good)), table.slice(last)

    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            found, rest = kept(pa.Table.from_batches(held), False)
            held = rest.combine_chunks().to_batches()
            yield found
    if sum(b.num_rows for b in held):
        yield kept(pa.Table.from_batches(held), True)[0]


def merge_tries(leaves: DataFrame, least: int) -> DataFrame:
    """Blocks of merged leaves in at least ``least`` documents: terms, and the counters of term k up to ends[k]."""

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _frequent(it, least):
            if not table.num_rows:
                continue
            firsts = _starts(table)
            lists, counts = (table.column(c).combine_chunks() for c in ("sources", "counts"))
            names = lists.flatten().dictionary_encode()
            leaf = np.repeat(np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, table.num_rows))), pc.list_value_length(lists).to_numpy())
            key = leaf * len(names.dictionary) + names.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            total = np.add.reduceat(counts.flatten().to_numpy()[order], at)
            leaf, source = np.divmod(key[order][at], len(names.dictionary))
            ends = np.searchsorted(leaf, np.arange(len(firsts)), side="right")
            sources, terms = names.dictionary.take(pa.array(source)), table.column("term").combine_chunks().take(pa.array(firsts))
            langs = table.column("lang").combine_chunks().take(pa.array(firsts)).to_pylist()
            k = 0
            for lang, own in groupby(langs):
                last = k + len(list(own))
                for a in range(k, last, BLOCK):
                    b, low = min(a + BLOCK, last), int(ends[a - 1]) if a else 0
                    part = slice(low, int(ends[b - 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), one(terms[a:b]), one(pa.array(ends[a:b] - low, pa.int32())), one(sources[part]), one(pa.array(total[part]))], schema=_BLOCK)
                k = last

    ordered = leaves.where("term is not null").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(blocks, _BLOCK_DDL)


def tiles(leaves: DataFrame, blocks: DataFrame, smooth: int) -> DataFrame:
    """Pairs of tiles of each language: lang, v (kept terms), whole (their occurrences), and names and sizes N + smooth * V of both tiles."""
    every = leaves.where("term is null").select("lang", F.explode("sources").alias("source")).distinct()
    counted = blocks.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("whole"))
    groups = every.join(counted, ["lang", "source"], "left").join(kept, "lang", "left").join(whole, "lang", "left").na.fill(0, ["n", "v", "whole"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source of a language
    own = groups.withColumn("tile", F.floor(place / TILE)).groupBy("lang", "tile", "v", "whole").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))
    size = F.col("v") * smooth
    one = own.select("lang", "v", (F.col("whole") + size).alias("whole"), F.col("tile").alias("a"), F.col("s.source").alias("names_a"), F.transform("s.n", lambda n: n + size).alias("sizes_a"))
    two = own.select("lang", F.col("tile").alias("b"), F.col("s.source").alias("names_b"), F.transform("s.n", lambda n: n + size).alias("sizes_b"))
    return one.join(two, "lang").where("a <= b")


def shares(counts: np.ndarray, sizes: np.ndarray, smooth: int) -> np.ndarray:
    """1 + floor(ONE * (count + smooth) / size), exact at any count."""
    if counts.size and int(counts.max()) > (2**63 - 1) // ONE - smooth:
        return (1 + ONE * (counts.astype(object) + smooth) // sizes.astype(object)).astype(np.int64)
    return 1 + ONE * (counts + smooth) // sizes


def _dense(names: list[str], ends: np.ndarray, sources: list[str], counts: np.ndarray) -> np.ndarray:
    """Counts of each term of a block (rows) and source of a tile (columns)."""
    column = {s: i for i, s in enumerate(names)}
    at = np.array([column.get(s, -1) for s in sources], np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    out = np.zeros((len(ends), len(names)), np.int64)
    out[row[at >= 0], at[at >= 0]] = counts[at >= 0]
    return out


_FOUND_DDL = "lang string, source string, part string, item binary, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def compare(blocks: DataFrame, pairs: DataFrame, smooth: int, ranks: int) -> DataFrame:
    """Shares of the pairs of sources (source before item), and candidates for the terms of each source, by blocks."""

    def pair_rows(names_a: list[str], names_b: list[str], value: np.ndarray, same: bool) -> list[tuple[str, bytes, int]]:
        return [(s, t.encode(), int(value[i, j])) for i, s in enumerate(names_a) for j, t in enumerate(names_b) if not same or i < j]

    def out(lang: str, part: str, rows: list[tuple[str, bytes, int]]) -> Iterator[pa.RecordBatch]:
        if rows:
            source, item, value = zip(*rows, strict=True)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([lang] * n, source, [part] * n, item, value), _FOUND, strict=True)], schema=_FOUND)

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, same, value, best = None, False, None, {}
        names_a: list[str] = []
        names_b: list[str] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            yield from out(key[0], "pair", pair_rows(names_a, names_b, value, same))
            yield from out(key[0], "term", [(s, t, -v) for s, own in best.items() for v, t in own])

        for batch in it:
            for r in batch.to_pylist():
                if key != (r["lang"], r["a"], r["b"]):
                    if key is not None:
                        yield from hand_on()
                    key, same, names_a, names_b, best = (r["lang"], r["a"], r["b"]), r["a"] == r["b"], r["names_a"], r["names_b"], {}
                    value = np.zeros((len(names_a), len(names_b)), np.int64)
                if not r["terms"]:
                    continue
                ends, counts = np.array(r["ends"]), np.array(r["counts"], np.int64)
                own = _dense(names_a, ends, r["sources"], counts)
                p = shares(own, np.array(r["sizes_a"], np.int64), smooth)
                q = p if same else shares(_dense(names_b, ends, r["sources"], counts), np.array(r["sizes_b"], np.int64), smooth)
                for i in range(len(names_a)):
                    value[i] += np.abs(p[:, i : i + 1] - q).sum(0)
                if same:
                    total = np.add.reduceat(counts, np.concatenate([[0], ends[:-1]]))
                    gap = p - shares(total, np.int64(r["whole"]), smooth)[:, None]
                    for i, source in enumerate(names_a):
                        some = np.flatnonzero((own[:, i] > 0) & (gap[:, i] > 0))
                        some = some[np.argsort(-gap[some, i], kind="stable")[:ranks]]  # terms of a block rise, so ties do
                        best[source] = sorted(best.get(source, []) + [(-int(gap[k, i]), r["terms"][k]) for k in some.tolist()])[:ranks]
        if key is not None:
            yield from hand_on()

    empty = pairs.select("lang", *(F.array().cast(f"array<{t}>").alias(c) for c, t in (("terms", "binary"), ("ends", "int"), ("sources", "string"), ("counts", "long")))).distinct()
    met = blocks.unionByName(empty).join(pairs, "lang").sortWithinPartitions("lang", "a", "b")
    return met.mapInArrow(found, _FOUND_DDL)


def source_divergence(docs: DataFrame, least: int = 30, smooth: int = 5, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by their distance, and the source's own terms.

    Terms in at least ``least`` documents of a language are kept. A source's share of a term is 1 + floor(10^9 * (count +
    smooth) / (N + smooth * V)), with N occurrences of V kept terms. Part pair sums the differences of two sources' shares;
    part term has the ``ranks`` terms whose share exceeds that of the whole language most.
    """
    leaves = materialise(count_terms(docs), "leaves")
    blocks = materialise(merge_tries(leaves, least), "blocks")
    found = compare(blocks, materialise(tiles(leaves, blocks, smooth), "tiles"), smooth, ranks)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term has one leaf, so one value
    both = summed.select("lang", F.explode(F.when(F.col("part") == "pair", F.array(F.struct("source", F.col("item").cast("string").alias("item")), F.struct(F.col("item").cast("string").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", F.col("item").cast("string").alias("item"))))).alias("p"), "part", "value")
    rows = both.select("lang", "p.source", "part", "p.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
