"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam.

Equal vectors are one node that keeps the few smallest ids an answer can need. Nodes are dealt to shards of bounded size.
In a shard greedy searches from the middle propose neighbours of each node; a neighbour is kept unless a kept one is
closer to it by a factor (relaxed distance pruning), so short and long edges stay. Queries, in blocks, run a beam search in
every shard; the best of all shards are ranked by exact cosines in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries
nor as candidates; likewise rows with a null id. Vectors of different lengths are not compared. Repeated rows of an id
are one candidate when their vectors are equal, else each is one. Ties go to the smaller id. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsparq.llm.shared import materialise

#: Nodes of a shard and queries of a block, about; edges of a node; beam of a building and of a querying search; factor of pruning.
SHARD, QUERY_BLOCK, EDGES, BEAM, QUERY_BEAM, ALPHA = 12_000, 24_000, 24, 48, 96, 1.2
BATCH = 256


def _near(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distances (1 - cosine of unit vectors) of each query to its own row of ids; -1 is infinitely far."""
    d = 1 - np.einsum("qd,qkd->qk", queries, vectors[np.maximum(ids, 0)])
    d[ids < 0] = np.inf
    return d


def beam_search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``beam`` nearest nodes met from ``start``, for all queries in step."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    ids[:, 0] = start
    dist = _near(vectors, queries, ids)
    done = np.zeros((n, beam), bool)
    while True:
        left = np.where(done | (ids < 0), np.inf, dist)
        active = np.flatnonzero(np.isfinite(left.min(1)))
        if not len(active):
            return ids, dist
        take = np.argpartition(left[active], 1, axis=1)[:, :2]  # the two nearest not yet expanded
        open_ = np.isfinite(np.take_along_axis(left[active], take, 1))
        source = np.where(open_, np.take_along_axis(ids[active], take, 1), -1)
        done[active[:, None], take] = True
        new = np.where(source[:, :, None] >= 0, graph[np.maximum(source, 0)], -1).reshape(len(active), -1)
        new = np.where((new[:, :, None] == ids[active][:, None, :]).any(2), -1, new)
        order = np.sort(new, axis=1)
        new = np.where(np.concatenate([np.zeros((len(active), 1), bool), order[:, 1:] == order[:, :-1]], axis=1), -1, order)
        all_ids = np.concatenate([ids[active], new], axis=1)
        all_dist = np.concatenate([dist[active], _near(vectors, queries[active], new)], axis=1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))
        ids[~np.isfinite(dist)] = -1


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, ids: np.ndarray, edges: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each node from its candidates ``ids`` (nodes, candidates)."""
    ids = np.where(ids == nodes[:, None], -1, ids)
    dist = _near(vectors, vectors[nodes], ids)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    out = np.full((len(nodes), edges), -1)
    alive = np.isfinite(dist)
    row = np.arange(len(nodes))
    for k in range(edges):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        chosen = np.where(some, ids[row, at], -1)
        out[:, k] = chosen
        between = _near(vectors, vectors[np.maximum(chosen, 0)], ids)
        alive &= ~(some[:, None] & (alpha * between <= dist + 1e-12))
        alive[row, at] = False
    return out


def build_graph(vectors: np.ndarray, edges: int = EDGES, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours of each node, start) over unit vectors."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    start = int((vectors @ vectors.mean(0)).argmax())
    graph = rng.integers(0, n, (n, edges)) if n > 1 else np.full((n, edges), -1)
    graph[graph == np.arange(n)[:, None]] = -1
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(vectors, graph, start, vectors[nodes], beam)
            graph[nodes] = robust_prune(vectors, nodes, np.concatenate([found, graph[nodes]], axis=1), edges, factor)
            back = np.stack([graph[nodes].ravel(), np.repeat(nodes, edges)], axis=1)
            back = back[back[:, 0] >= 0]
            back = back[np.argsort(back[:, 0], kind="stable")]
            ends, first, count = np.unique(back[:, 0], return_index=True, return_counts=True)
            more = np.full((len(ends), min(int(count.max(initial=1)), 3 * edges)), -1)
            for k in range(more.shape[1]):
                has = count > k
                more[has, k] = back[first[has] + k, 1]
            more = np.where((more[:, :, None] == graph[ends][:, None, :]).any(2), -1, more)
            room = (graph[ends] < 0).sum(1)
            need = (more >= 0).sum(1)
            fits = need <= room
            joined = np.concatenate([graph[ends], more], axis=1)
            packed = -np.sort(-joined[fits], axis=1)[:, :edges]
            graph[ends[fits]] = packed
            if (~fits).any():
                graph[ends[~fits]] = robust_prune(vectors, ends[~fits], joined[~fits], edges, factor)
    return graph, start


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of each row and q in double precision; all are first scaled by a power of two, exactly, so that no square overflows."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    return rows @ q / (np.sqrt((rows**2).sum(1)) * np.sqrt((q**2).sum()))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(F.coalesce(finite & some, F.lit(False)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates found for each row whose vec_id is divisible by ``every``."""
    from pyspark.sql import Window

    rows = materialise(usable(vectors).distinct(), "vectors")
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n")
    nodes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    nodes = materialise(nodes.withColumn("dim", F.size("embedding")), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def build(key, group):  # noqa: ANN001, ANN202  pandas frame
        import pandas as pd

        group = group.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        own = np.array(group["embedding"].tolist(), float)
        graph, start = build_graph(_unit(own))
        ids = np.array([[*x, *[-1] * (k + 1 - len(x))] for x in group["ids"]], np.int64)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "data": [_pack(own=own, graph=graph.astype(np.int32), start=np.array(start), ids=ids)]})

    index = materialise(nodes.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, data binary"), "index")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    asked = asked.join(parts, F.col("dim") == F.col("_dim")).select("vec_id", "embedding", "dim", "_shard", "block")  # every query to every shard of its length
    where = index.select("dim", "shard", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(key, queries, shard_rows):  # noqa: ANN001, ANN202  pandas frames
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(shard_rows):
            data = np.load(io.BytesIO(shard_rows["data"].iloc[0]))
            own, graph, start, ids = (data[x] for x in ("own", "graph", "start", "ids"))
            unit, asked_by = _unit(own), queries["vec_id"].to_numpy()
            given = np.array(queries["embedding"].tolist(), float)
            for at in range(0, len(given), BATCH):
                q = given[at : at + BATCH]
                found, _ = beam_search(unit, graph, int(start), _unit(q), min(QUERY_BEAM, max(len(own), 2)))
                for i, (query, nodes_) in enumerate(zip(asked_by[at : at + BATCH], found, strict=True)):
                    nodes_ = nodes_[nodes_ >= 0]
                    near = cosines(own[nodes_], q[i])
                    names = ids[nodes_]
                    score = np.broadcast_to(near[:, None], names.shape)[(names >= 0) & (names != query)]
                    names = names[(names >= 0) & (names != query)]
                    best = np.lexsort((names, -score))[:k]
                    out["query_id"] += [query] * len(best)
                    out["vec_id"] += names[best].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    grouped = asked.groupBy("dim", "_shard", F.col("block").cast("long")).cogroup(where.groupBy("dim", "shard", "block"))
    hits = grouped.applyInPandas(search, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
