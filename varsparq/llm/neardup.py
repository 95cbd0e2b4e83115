"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

One bijection spreads the shingles over 32-bit places, a second one, shifted circularly by 0, 1, 2, ... places, gives
every coordinate of the signature. Documents that agree in a whole band of coordinates are candidates. Similarity of
candidates is confirmed on their full sets of 64-bit shingle hashes.

Candidates are not expanded to all pairs of a bucket. Copies (equal sets) are one class. Each class is first compared
with the leader of each of its buckets: the one that meets most others over all bands, so the original of a crowd of
copies. In buckets that still hold several components after that, the classes outside of the bucket's largest component are
held against the others. For this the buckets of one largest component are one group: a class goes there once, with its
set, and only if sizes and sketches allow it to be similar to a class of another component in one of its buckets. Pairs are
compared in place, and a group gives back links only; a large group is cut into blocks of bounded bytes. So no link between
different components is lost that a band finds; a pair at a similarity of 0.8 agrees in no band with a probability of
5e-7, and differs in so many sketch bits that it is not compared with one of 1e-9.

Defined cases: null texts and texts without words have an empty set and no link. A text of fewer words than a shingle is
one shingle. Very long texts are read whole; a set takes 8 bytes a shingle. Rows with the same id are one document
(linked); rows with a null id have no links and a null component, and are kept. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsparq.llm.components import components
from varsparq.llm.shared import map_texts, materialise, text_batches
from varsparq.llm.texts import mix, shingle_set
from varsparq.storage import settled

BANDS, ROWS = 48, 6
#: Bits of a sketch (the lowest of as many coordinates) and how many may differ between candidates: 25.6 are expected at 0.8.
SKETCH, MOST_BITS = 256, 58
_BITS = [f"bits_{k}" for k in range(SKETCH // 64)]
#: Bytes of sets on either side of a comparison, about; a larger group is cut into blocks.
BLOCK = 48 << 20
#: Members of a bucket whose sets one task holds against that of the leader, about.
LED = 1_000
#: Ids that are broadcast at most (16 bytes each); more are joined by shuffle.
FEW_IDS = 500_000
_PART = 4096


def _place(x: np.ndarray) -> np.ndarray:
    """The shifted bijection on 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least place of the set under the second bijection shifted by k."""
    places = (mix(shingles + np.uint64(0x51ED2701)) >> np.uint64(32)).astype(np.uint32)  # the first bijection
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _PART):
        np.minimum(least, _place(places[None, at : at + _PART] - shift).min(1), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_1 and set_2 (a 128-bit print of the set, null when empty), bands (array of keys), _BITS (the sketch)."""
    names = ["n_shingles", "set_1", "set_2", "bands", *_BITS]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *(pa.int64() for _ in _BITS)]

    def row(text: str | None) -> tuple:
        s = shingle_set(text, words)
        if not len(s):
            return 0, *[None] * (len(names) - 1)
        sig = signature(s)
        bits = np.packbits((sig[:SKETCH] & 1).astype(np.uint8)).view(np.int64)
        prints = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s * np.uint64(3) + np.uint64(len(s))))
        return len(s), *(int(x.view(np.int64)) for x in prints), band_keys(sig), *bits.tolist()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(*(row(t) for t in batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    told = ", ".join(f"{c} {'array<long>' if c == 'bands' else 'long'}" for c in names)
    return map_texts(docs.select(id_col, text_col), rows, f"{id_col} {kind}, {told}")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _plausible(percent: int, a: str = "", b: str = "_b") -> Column:
    """Sizes and sketches allow the similarity."""
    n, m = F.col(f"n_shingles{a}"), F.col(f"n_shingles{b}")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differ(a, b) <= MOST_BITS)


def _differ(a: str = "", b: str = "_b") -> Column:
    """Bits that differ between two sketches."""
    return sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in _BITS), F.lit(0))


def _renamed(df: DataFrame, columns: list[str], end: str = "_b") -> list[Column]:
    return [df[c].alias(f"{c}{end}") for c in columns]


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar. ``pairs`` is a table; v should be the end with fewer distinct ids.

    The set of each u is made where its text lies and goes to each of its v once.
    """
    @F.pandas_udf("boolean")
    def similar(a, b):  # noqa: ANN001, ANN202  pandas series
        import pandas as pd

        return pd.Series([_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    few = pairs.count() <= FEW_IDS
    sets = lambda end, name: _sets(pairs.select(F.col(end).alias("id")).distinct(), docs, words).toDF(end, name)
    crowd = pairs.groupBy("v").agg(F.ceil(F.count("*") / LED).cast("int").alias("pieces"))
    crowd = materialise(crowd, "crowds")
    dealt = pairs.join(F.broadcast(crowd) if few else crowd, "v").select("u", "v", F.pmod(F.xxhash64("u"), "pieces").cast("int").alias("piece"))
    own = sets("u", "a").join(F.broadcast(dealt) if few else dealt, "u")
    leaders = sets("v", "b").join(F.broadcast(crowd) if few else crowd, "v").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return own.join(leaders, ["v", "piece"]).where(similar("a", "b")).select("u", "v").distinct()


def led_pairs(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes and the leaders v of their buckets that sizes and sketches allow. ``buckets``: key, met, id."""
    facts = ["id", "n_shingles", *_BITS]
    mass = buckets.groupBy("id").agg(F.sum("met").alias("mass"))
    first = F.max(F.struct("mass", F.negative("id").alias("low_id"))).alias("b")
    leader = buckets.join(mass, "id").groupBy("key").agg(first).select("key", F.negative("b.low_id").alias("v"))
    pairs = buckets.join(leader, "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    told = classes.select(facts)
    pairs = pairs.join(told.select(F.col("id").alias("u"), *facts[1:]), "u").join(told.select(F.col("id").alias("v"), *_renamed(told, facts[1:])), "v")
    return pairs.where(_plausible(percent)).select("u", "v").distinct()


def _met(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The rows with a plausible partner of another component among ``others`` of their bucket."""
    other = others.select(_renamed(others, ["key", "component", "n_shingles", *_BITS]))
    return rows.join(other, (F.col("key") == F.col("key_b")) & (F.col("component") != F.col("component_b")) & _plausible(percent), "left_semi")


def late_links(buckets: DataFrame, classes: DataFrame, near: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between different components of ``near`` that share a bucket.

    A bucket's largest component need not ask, as every pair between components has an end outside of it.
    """
    whole = buckets.select("key", "id").join(near.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = whole.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", F.negative("component").alias("c"))).alias("top")
    mixed = parts.groupBy("key").agg(largest, F.count("*").alias("parts")).where("parts > 1").select("key", F.negative("top.c").alias("most"))
    told = whole.join(mixed, "key").join(classes.select("id", "n_shingles", *_BITS), "id")
    open_ = materialise(told.withColumn("asks", F.col("component") != F.col("most")), "open")
    asking, quiet = open_.where("asks"), open_.where("not asks")
    hits = _met(asking, open_, percent).unionByName(_met(quiet, asking, percent))
    hits = materialise(hits.select("most", "id", "component", "asks", "n_shingles", *_BITS).distinct(), "plausible")

    blocks = lambda c: F.greatest(F.ceil(F.sum(c) * 8 / BLOCK), F.lit(1)).cast("int")
    sizes = hits.groupBy("most").agg(blocks(F.col("n_shingles")).alias("across"), blocks(F.when(F.col("asks"), F.col("n_shingles")).otherwise(0)).alias("down"))
    mine = {"i": F.pmod(F.xxhash64("id", F.lit(1)), "down").cast("int"), "j": F.pmod(F.xxhash64("id"), "across").cast("int")}
    met = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct(i.alias("i"), mine["j"].alias("j")))
    meets = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: F.struct(mine["i"].alias("i"), j.alias("j")))
    cells = hits.join(sizes, "most").withColumn("cell", F.explode(F.when(F.col("asks"), F.array_union(met, meets)).otherwise(met)))
    cells = cells.select("most", "cell.*", "id", "component", "asks", *_BITS, (F.col("cell.i") == mine["i"]).alias("asks_here"), (F.col("cell.j") == mine["j"]).alias("is_met"))
    ids = hits.select("id").distinct()
    rows = cells.join(_sets(ids, docs, words), "id")

    def compare(group):  # noqa: ANN001, ANN202  pandas frame
        import pandas as pd

        group = group[group["shingles"].map(len) > 0]  # an id may have another row, without words
        if not len(group):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        ids, component, asks, here = (group[c].to_numpy() for c in ("id", "component", "asks", "asks_here"))
        bits = group[_BITS].to_numpy().astype(np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sets = np.split(codes, np.cumsum(size)[:-1])  # shingles as numbers of this group
        component, mark = component.copy(), np.zeros(codes.max() + 1, bool)
        u, v = [], []
        at = np.flatnonzero(group["is_met"].to_numpy())
        for k in np.flatnonzero(asks & here).tolist():
            fit = (component[at] != component[k]) & (100 * np.minimum(size[at], size[k]) >= percent * np.maximum(size[at], size[k]))
            fit &= ~asks[at] | (ids[at] < ids[k])  # of two that ask, one meets the other
            some = at[fit]
            some = some[np.bitwise_count(bits[some] ^ bits[k]).sum(1) <= MOST_BITS]
            if not len(some):
                continue
            mark[sets[k]] = True
            starts = np.cumsum(size[some]) - size[some]
            both = np.add.reduceat(mark[np.concatenate([sets[x] for x in some.tolist()])], starts, dtype=np.int64)
            mark[sets[k]] = False
            for x in some[100 * both >= percent * (size[some] + size[k] - both)].tolist():
                a, b = component[k], component[x]
                if a != b:
                    component[component == max(a, b)] = min(a, b)
                    u.append(ids[k]), v.append(ids[x])
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return rows.groupBy("most", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id and shingles (sorted 64-bit hashes as binary) of the documents in ``ids`` (id, distinct), made anew from their texts."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def shingles(texts):  # noqa: ANN001, ANN202  pandas series
        return texts.map(lambda t: shingle_set(t, words).tobytes())

    few = ids.count() <= FEW_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", shingles("text").alias("shingles"))


def _ends(near: DataFrame) -> DataFrame:
    """A link from each node to its component."""
    return near.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links), kept (id = component_id) of each row of ``docs``.

    words: of a shingle; percent: least similarity of a link. Ids are whole numbers.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = materialise(signatures(plain, words, "id"), "signatures")
    linked = table.where("id is not null and set_1 is not null")
    facts = ["n_shingles", "bands", *_BITS]  # alike for equal sets
    grouped = linked.groupBy("set_1", "set_2").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in facts))
    classes = materialise(grouped, "classes")
    several = classes.where("rows > 1").select(F.col("id").alias("v"), "set_1", "set_2")
    copies = linked.select(F.col("id").alias("u"), "set_1", "set_2").join(several, ["set_1", "set_2"]).where("u <> v").select("u", "v").distinct()
    copies = materialise(copies, "copies")

    keys = classes.select("id", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    buckets = materialise(keys.join(met, "key"), "buckets")
    led = confirmed(materialise(led_pairs(buckets, classes, percent), "led"), plain, words, percent)
    near = materialise(components(led), "components")
    late = materialise(late_links(buckets, classes, near, plain, words, percent), "late")
    final = components(_ends(near).unionByName(late).unionByName(copies))
    out = table.join(final, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group, with all columns. Of rows with one doc_id the first by text stays."""
    found = settled(lambda: near_duplicates(docs, words, percent).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    # joined by shuffle at every size, as ids grow with the documents; both joins read one shuffle of them
    ids = lambda some: found.where(some).select("doc_id").hint("merge")
    single = docs.join(ids("rows = 1"), "doc_id", "left_semi")
    several = docs.join(ids("rows > 1"), "doc_id", "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    order = F.struct(F.col("row.text").isNull(), "row.text", F.xxhash64("row"))
    first = several.groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", order).alias("row")).select("row.*")
    return single.select(*docs.columns).unionByName(first).unionByName(docs.where("doc_id is null"))
