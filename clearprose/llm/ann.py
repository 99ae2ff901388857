"""Nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node. Nodes are dealt by hash into shards of bounded expected
size; a shard's graph starts random and is rebuilt in two passes of batches: a
greedy beam search from the medoid proposes neighbours, robust pruning drops a
candidate that is nearer (by the factor ALPHA) to a kept one than to the node, and
edges are added back and pruned again. Each shard is a row of an index table.
Queries, in blocks, meet every shard in a Cartesian product of the two tables' splits, so
nothing is broadcast and no copies of blocks are shuffled; a beam search gives the
shard's nearest, scored by the cosine in double precision on the original vectors,
and a window over a query keeps the nearest of all shards.

Defined results: vectors that are null, zero or hold null or non-finite components,
and rows with a null id, take no part; vectors of different lengths are not
compared; repeated rows count once; of equal vectors only the smallest ids can be
among the nearest, and just as many as can be are kept with the node; ties go to the
smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearprose.llm.tables import Workspace
from clearprose.llm.vectors import matrix, unit, usable

NEAREST = 5
SHARD = 4096
QUERY_BLOCK = 512
DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM = 192
#: Nodes whose neighbours are looked up in one step of a search.
WIDE = 4
BATCH = 512
#: Queries whose found nodes are scored at once.
SCORED = 64
_FAR = np.float32(np.inf)


def search(graph: np.ndarray, x: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (-1: none) and squared distances of the nearest found, nearest first."""
    n, nodes = len(queries), len(x)
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), _FAR, np.float32)
    ids[:, 0], far[:, 0] = start, 2 - 2 * (queries @ x[start])
    seen = np.zeros((n, beam), bool)
    # nodes met by each query: one that fell out of its beam can't come back
    met = np.zeros((n, nodes), bool)
    met[:, start] = True
    flat, last = met.ravel(), np.zeros(n * nodes, np.int32)
    live = np.arange(n)
    while len(live):
        open_ = ~seen[live] & (ids[live] >= 0)
        rows, pick = np.nonzero(open_ & (np.cumsum(open_, axis=1, dtype=np.int32) <= WIDE))
        if not len(rows):
            break
        query = live[rows]
        live = live[open_.any(axis=1)]
        seen[query, pick] = True
        near = graph[ids[query, pick]]
        query, near = np.repeat(query, near.shape[1]), near.ravel()
        cell = query * nodes + near
        fresh = np.flatnonzero(near >= 0)
        fresh = fresh[~flat[cell[fresh]]]
        # of equal ones among the neighbours of one step, the last stands
        last[cell[fresh]] = fresh
        fresh = fresh[last[cell[fresh]] == fresh]
        query, near = query[fresh], near[fresh]
        flat[cell[fresh]] = True
        d = (2 - 2 * np.einsum("ad,ad->a", x[near], queries[query])).astype(np.float32)
        closer = d < far[query, -1]
        query, near, d = query[closer], near[closer], d[closer]
        if not len(query):
            continue
        some, first, count = np.unique(query, return_index=True, return_counts=True)
        row, place = np.repeat(np.arange(len(some)), count), beam + np.arange(len(query)) - np.repeat(first, count)
        all_ids, all_d, all_seen = (np.full((len(some), beam + count.max()), v, k) for v, k in ((-1, np.int64), (_FAR, np.float32), (False, bool)))
        all_ids[:, :beam], all_d[:, :beam], all_seen[:, :beam] = ids[some], far[some], seen[some]
        all_ids[row, place], all_d[row, place] = near, d
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[some], far[some], seen[some] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_d, all_seen))
    return ids, far


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Kept neighbours (-1: none) of each node from its row of candidates (-1: none)."""
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == nodes[:, None]] = -1
    d = 2 - 2 * np.einsum("bcd,bd->bc", x[order], x[nodes], optimize=True)
    d[order < 0] = _FAR
    by = np.argsort(d, axis=1, kind="stable")
    ids, d = np.take_along_axis(order, by, 1), np.take_along_axis(d, by, 1)
    between = 2 - 2 * np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    alive = d < _FAR
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = ids[rows[some], first[some]]
        alive &= ~((alpha * alpha * between[rows, first] <= d) & some[:, None])
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """The graph over unit rows x (-1: no edge), and the node where searches start."""
    n = len(x)
    start = int((x @ x.mean(axis=0)).argmax())
    random = np.random.default_rng(n)
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        graph[:, : min(degree, n - 1)] = (np.arange(n)[:, None] + random.integers(1, n, (n, min(degree, n - 1)))) % n
    for alpha in (1.0, ALPHA):
        for nodes in np.array_split(random.permutation(n), max(1, -(-n // BATCH))):
            found, _ = search(graph, x, x[nodes], start, beam)
            graph[nodes] = prune(x, nodes, np.hstack([found, graph[nodes]]), alpha, degree)
            source, target = np.repeat(nodes, degree), graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            touched, first = np.unique(target, return_index=True)
            place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
            for part in np.array_split(np.arange(len(touched)), max(1, -(-len(touched) // BATCH))):
                if not len(part):
                    continue
                width = int(np.diff(np.append(first, len(target)))[part].max())
                back = np.full((len(part), width), -1, np.int64)
                mine = np.isin(target, touched[part])
                back[np.searchsorted(touched[part], target[mine]), place[mine]] = source[mine]
                both = np.hstack([graph[touched[part]], back])
                over = (both >= 0).sum(axis=1) > degree
                packed = -np.sort(-both, axis=1)[:, :degree]
                if over.any():
                    packed[over] = prune(x, touched[part][over], both[over], alpha, degree)
                graph[touched[part]] = packed
    return graph, start


def _index(group: pa.Table) -> pa.Table:
    v = matrix(group["v"])
    graph, start = build(unit(v).astype(np.float32))
    ids = group["ids"].combine_chunks()
    return pa.table({
        "shard": group["shard"][:1].combine_chunks(), "size": group["size"][:1].combine_chunks(), "start": pa.array([start], pa.int32()), "v": pa.array([v.tobytes()], pa.binary()),
        "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()), "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()), "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary()),
    })


def _block(group: pa.Table) -> pa.Table:
    return pa.table({"size": group["size"][:1].combine_chunks(), "q": pa.array([matrix(group["v"]).tobytes()], pa.binary()), "q_ids": pa.array([group["vec_id"].to_numpy().tobytes()], pa.binary())})


def _searched(nearest: int):
    def run(batches):
        for batch in batches:
            # a row is a whole shard beside a block: only one is held as bytes
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                width = r["size"]
                v, q = (np.frombuffer(r[c], np.float64).reshape(-1, width) for c in ("v", "q"))
                graph = np.frombuffer(r["graph"], np.int32).reshape(-1, DEGREE).astype(np.int64)
                counts = np.frombuffer(r["counts"], np.int32)
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                first = np.append(0, np.cumsum(counts))
                found, _ = search(graph, unit(v).astype(np.float32), unit(q).astype(np.float32), r["start"], SEARCH_BEAM)
                # powers of two leave the digits alone; no norm overflows or vanishes
                v, q = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (v, q))
                norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
                told = []
                for at in range(0, len(q), SCORED):
                    row, place = np.nonzero(found[at : at + SCORED] >= 0)
                    row += at
                    node = found[row, place]
                    score = np.einsum("ad,ad->a", v[node], q[row]) / (norm[node] * q_norm[row])
                    # the ids of each node, one after another
                    n = counts[node]
                    best = ids[np.repeat(first[node] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
                    row, score = np.repeat(row, n), np.repeat(score, n)
                    row, score, best = (x[best != q_ids[row]] for x in (row, score, best))
                    by = np.lexsort((best, -score, row))
                    row, score, best = row[by], score[by], best[by]
                    top = np.arange(len(row)) - np.searchsorted(row, row) < nearest
                    told.append((q_ids[row[top]], best[top], score[top]))
                out = [pa.array(np.concatenate(x)) for x in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays(out, ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query but its own."""
    work = Workspace(rows.sparkSession, "ann")
    own = lambda df: df.filter(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    # the smallest ids of each vector, in two steps so that a very common one is dealt out first
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("v").orderBy("vec_id")
    few = own(rows).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1)
    nodes = work.written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("size", F.size("v")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v", F.lit(17)), F.lit(shards)).cast("int"))
    index = work.written(dealt.groupBy("shard", "size").applyInArrow(_index, "shard int, size int, start int, v binary, graph binary, ids binary, counts binary"), "index")
    asked = work.written(own(queries).withColumn("size", F.size("v")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = work.written(asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("size", "b").applyInArrow(_block, "size int, q binary, q_ids binary"), "blocks")
    # a broadcast of the blocks times the shards would pass the driver, whatever the files of one copy weigh
    found = index.join(packed.hint("shuffle_replicate_nl"), "size").mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
