"""Best-fit packing of token pieces into sequences, with swap-based local search.

Texts are tokenised once; pieces (numbers only) go to the shared folder and are dealt to shards of bounded size. In a
shard, best fit in falling order of length starts; then pieces of the emptiest sequences are moved, or exchanged one for
one or two for one, into sequences with room, each step increasing the sum of squared fills, until sequences are empty.

Defined cases: a null or empty text is a document with the end id alone. Repeated rows, and rows with a null id, are
documents of their own. Only documents longer than a sequence are cut. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import map_texts, materialise
from varsparq.llm.tokens import collector_off, encoder

#: Pieces of a shard, about. A shard ends with one sequence that is not full.
SHARD = 20_000
#: Entries of an encoder's caches: packing ends a pipeline, whose other stages leave less memory in the same workers.
ENTRIES = 650_000


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of ``docs`` (doc_id, text)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        end, out = np.array([end_id], "<u4").tobytes(), []
        with collector_off():
            encoded = encoder(vocabulary, ENTRIES).encode_all(batch.column(1))
        for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*out, strict=True)
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", encodes=True)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the fullest bin with room. A bit for each free length finds it."""
    bins: list[list[int]] = []
    with_free: list[list[int]] = [[] for _ in range(size + 1)]
    bits = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = bits >> n
        if room:
            free = n + (room & -room).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                bits &= ~(1 << free)
        else:
            b, free = len(bins), size
            bins.append([])
        bins[b].append(i)
        left = free - n
        if left:
            with_free[left].append(b)
            bits |= 1 << left
    return bins


class _Groups:
    """Bins by free room, with bit sets of the lengths of their pieces and of pairs of pieces, made anew for a group that changed."""

    def __init__(self, lengths: list[int], held: list[set[int]], size: int) -> None:
        self.lengths, self.held = lengths, held
        self.free = [size - sum(lengths[i] for i in h) for h in held]
        self.bins: dict[int, set[int]] = {}
        self.bits = 0  # of rooms that bins have
        self._sets: dict[int, tuple[int, int]] = {}
        for k in range(len(held)):
            self.add(k)

    def add(self, k: int) -> None:
        f = self.free[k]
        if f and self.held[k]:
            self.bins.setdefault(f, set()).add(k)
            self.bits |= 1 << f
            self._sets.pop(f, None)

    def remove(self, k: int) -> None:
        f = self.free[k]
        if k in self.bins.get(f, ()):
            self.bins[f].discard(k)
            self._sets.pop(f, None)
            if not self.bins[f]:
                del self.bins[f]
                self.bits &= ~(1 << f)

    def sets(self, f: int) -> tuple[int, int]:
        """(lengths of single pieces, sums of two pieces) of bins with room f."""
        if f not in self._sets:
            ones = twos = 0
            for k in self.bins[f]:
                seen = 0
                for i in self.held[k]:
                    twos |= seen << self.lengths[i]
                    seen |= 1 << self.lengths[i]
                ones |= seen
            self._sets[f] = ones, twos
        return self._sets[f]

    def give(self, i: int, source: int, to: int) -> None:
        self.held[source].discard(i)
        self.held[to].add(i)
        self.free[source] += self.lengths[i]
        self.free[to] -= self.lengths[i]


def _least_from(bits: int, least: int) -> int | None:
    """The lowest bit set from ``least`` on."""
    rest = bits >> least
    return least + (rest & -rest).bit_length() - 1 if rest else None


def _step(groups: _Groups, source: int) -> tuple[int, int, list[int]] | None:
    """(piece of the source, other bin, its pieces in return) of the best step from a bin taken out of the groups, or None if it is stuck.

    Longest pieces first: a move to the fullest bin with room, else the exchange that leaves the source least. The other
    bin is as full as the source at least, so that squared fill increases.
    """
    lengths, most = groups.lengths, groups.free[source]
    rooms = [f for f in groups.bins if f <= most]
    seen: set[int] = set()
    for i in sorted(groups.held[source], key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if n in seen:
            continue
        seen.add(n)
        f = _least_from(groups.bits, n)
        if f is not None and f <= most:
            return i, min(groups.bins[f]), []
        best = (0, 0, 0)  # gain, pieces in return (negative), room (negative)
        for f in rooms:
            for count, bits in enumerate(groups.sets(f), 1):
                back = _least_from(bits, n - f) if f < n else None
                if back is not None and back < n:
                    best = max(best, (n - back, -count, -f))
        gain, count, f = best
        if gain:
            for k in sorted(groups.bins[-f]):
                by = {}
                for j in sorted(groups.held[k]):
                    if count == -1 and lengths[j] == n - gain:
                        return i, k, [j]
                    if count == -2 and (other := by.get(n - gain - lengths[j])) is not None:
                        return i, k, [other, j]
                    by.setdefault(lengths[j], j)
    return None


def local_search(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull bins until none is left that would increase the sum of squared fills.

    Partners are found by length, among all pieces of all bins. The emptiest bins go first; a pass over all ends the search
    when it makes no step, or when there are as few bins as the lengths allow.
    """
    lengths = [int(n) for n in lengths]
    least = -(-sum(lengths) // size)
    if len(bins) <= least:
        return bins
    held = [set(b) for b in bins]
    groups = _Groups(lengths, held, size)
    alive, moved = len(bins), True
    while moved and alive > least:
        moved = False
        todo = [(-groups.free[k], k) for k in range(len(held)) if held[k] and groups.free[k]]
        heapq.heapify(todo)
        while todo and alive > least:
            free, source = heapq.heappop(todo)
            if not held[source] or groups.free[source] != -free:  # it changed since
                continue
            groups.remove(source)
            found = _step(groups, source)
            if found is None:
                groups.add(source)
                continue
            i, other, back = found
            groups.remove(other)
            groups.give(i, source, other)
            for j in back:
                groups.give(j, other, source)
            moved = True
            for k in (source, other):
                groups.add(k)
                if held[k] and groups.free[k]:
                    heapq.heappush(todo, (-groups.free[k], k))
            alive -= not held[source]
    return [sorted(h) for h in held if h]


def pack(table: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces."""
    shards = max(1, -(-table.count() // SHARD))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in table.schema)}, sequence_id long, offset long"

    def place(key, group):  # noqa: ANN001, ANN202  pandas frame
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for k, members in enumerate(local_search(lengths, best_fit(lengths, size), size)):
            sequence[members] = key[0] + k * shards
            offset[members] = np.concatenate([[0], lengths[members].cumsum()[:-1]])
        return group.assign(sequence_id=sequence, offset=offset).drop(columns="_shard")

    dealt = table.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("_shard").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of ``docs``."""
    return pack(materialise(pieces(docs, vocabulary, size, end_id), "pieces"), size)
