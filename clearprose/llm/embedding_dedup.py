"""Near-duplicate embeddings by collision counting over sorted projections.

Equal vectors of a label are one class first. Each label's classes are dealt into
cells by the signs of a few random projections, anew in each of several tables; the
more rows a label has, the more signs, so cells keep their size, and there are so
many tables that a pair at the threshold shares a cell with probability
1 - MISS. Inside a cell, vectors are sorted along PROJECTIONS further random lines;
around each vector, a window of WIDTH on each line gives collisions, counted per
pair; pairs with at least the count that a pair at the threshold reaches with
probability 1 - MISS are verified by the cosine in double precision. A cell with
more than BLOCK rows (a dense cluster) is cut into blocks and its block pairs are
separate groups. Links are counted where a pair first shares a cell and leave the
group as counts and local components, never as pairs.

Defined results: vectors that are null, zero or hold null or non-finite components,
and rows with a null label, link with nothing; rows with a null id get no links and
a null component; vectors of different lengths never link; repeated rows count once
and each get the same result; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.graph import components
from clearprose.llm.tables import Workspace
from clearprose.llm.vectors import matrix, planes, unit, usable

THRESHOLD = 0.93
#: Rows of a cell aimed at, and most rows of one side of a group.
CELL, BLOCK = 256, 512
PROJECTIONS, WIDTH = 32, 0.45
MISS = 1e-7
MOST_SIGNS = 20


def same_sign(threshold: float) -> float:
    """Probability that a random projection of a pair at the threshold has one sign."""
    return 1 - math.acos(threshold) / math.pi


def tables_for(signs: int, threshold: float) -> int:
    p = same_sign(threshold) ** signs
    return 1 if signs == 0 else math.ceil(math.log(MISS) / math.log(1 - p))


def least_collisions(threshold: float) -> int:
    """Largest count that a pair at the threshold misses with probability MISS at most."""
    p = math.erf(WIDTH / math.sqrt(2 - 2 * threshold) / math.sqrt(2))
    below = 0.0
    for count in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > MISS:
            return count
    return PROJECTIONS


def cells_of(u: np.ndarray, signs: int, threshold: float) -> np.ndarray:
    """(vectors, tables) cell numbers."""
    tables = tables_for(signs, threshold)
    if signs == 0:
        return np.zeros((len(u), 1), np.int64)
    bits = (u @ planes(7, tables * signs, u.shape[1]) > 0).reshape(len(u), tables, signs)
    return bits @ (1 << np.arange(signs))


def collisions(a: np.ndarray, b: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """For each pair of rows, on how many lines b's place is in the window around a's."""
    count = np.zeros((len(a), len(b)), np.uint8)
    for pa_, pb in zip((a @ lines).T, (b @ lines).T, strict=True):
        order = np.argsort(pb, kind="stable")
        place = np.empty(len(b), np.int16)
        place[order] = np.arange(len(b), dtype=np.int16)
        low = np.searchsorted(pb[order], pa_ - WIDTH, "left").astype(np.int16)
        high = np.searchsorted(pb[order], pa_ + WIDTH, "right").astype(np.int16)
        count += (place[None, :] >= low[:, None]) & (place[None, :] < high[:, None])
    return count


def linked_pairs(a: np.ndarray, b: np.ndarray, table: int, threshold: float, needed: int) -> np.ndarray:
    """Boolean matrix of verified links between unit rows a and b."""
    r, c = np.nonzero(collisions(a, b, planes(1000 + table, PROJECTIONS, a.shape[1])) >= needed)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(r), 1 << 14):
        x, y = r[at : at + (1 << 14)], c[at : at + (1 << 14)]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return out


def _group(threshold: float):
    needed = least_collisions(threshold)

    def found(group: pa.Table) -> pa.Table:
        ids, times = group["id"].to_numpy(), group["n"].to_numpy()
        table, signs = group["t"][0].as_py(), group["signs"][0].as_py()
        side, i, j = group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        u = unit(matrix(group["v"]))
        before = cells_of(u, signs, threshold)[:, :table]
        x, y = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links = linked_pairs(u[x], u[y], table, threshold, needed)
        if i == j:
            np.fill_diagonal(links, False)
        low = ids.copy()
        while True:  # local components by their smallest id
            last = low.copy()
            big = np.iinfo(np.int64).max
            if links.any():
                np.minimum.at(low, x, np.where(links, low[y][None, :], big).min(axis=1))
                np.minimum.at(low, y, np.where(links, low[x][:, None], big).min(axis=0))
            if np.array_equal(last, low):
                break
        r, c = np.nonzero(links)
        first = ~(before[x[r]] == before[y[c]]).any(axis=1)
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, x[r[first]], times[y[c[first]]])
        if i != j:
            np.add.at(count, y[c[first]], times[x[r[first]]])
        keep = np.flatnonzero((count > 0) | (low != ids))
        return pa.table({"id": ids[keep], "links": count[keep], "low": low[keep]})

    return found


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    work = Workspace(rows.sparkSession, "vectors")
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.when(usable(vector), F.col(vector)).alias("v"))
    good = every.filter("v is not null and label is not null and vec_id is not null")
    classes = work.written(good.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    sized = classes.withColumn("size", F.size("v"))
    signs = F.greatest(F.lit(0), F.least(F.lit(MOST_SIGNS), F.ceil(F.log2(F.col("rows") / CELL)))).cast("int").alias("signs")
    sizes = work.written(sized.groupBy("label", "size").agg(F.count("*").alias("rows")).select("label", "size", signs), "sizes")

    def dealt(batches):
        for b in batches:
            if not b.num_rows:
                continue
            signs, widths = b.column(4).to_numpy(), b.column(5).to_numpy()
            for s, w in sorted(set(zip(signs.tolist(), widths.tolist(), strict=True))):
                mine = np.flatnonzero((signs == s) & (widths == w))
                part = b.take(pa.array(mine))
                cells = cells_of(unit(matrix(part.column(3))), s, threshold)
                for t in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), part.column(4), part.column(5), pa.array(np.full(len(mine), t, np.int32)), pa.array(cells[:, t])], ["label", "id", "n", "v", "signs", "size", "t", "cell"])

    kinds = dict(classes.dtypes)
    schema = f"label {kinds['label']}, id long, n long, v {kinds['v']}, signs int, size int, t int, cell long"
    placed = sized.join(sizes, ["label", "size"]).select("label", "id", "n", "v", "signs", "size").mapInArrow(dealt, schema)
    key = ["label", "size", "t", "cell"]
    large = work.written(placed.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"), "large")
    blocks = F.coalesce("blocks", F.lit(1))
    cut = placed.join(large, key, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "t"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    spread = cut.withColumn("pair", F.explode(pairs)).select(*key, "id", "n", "v", "signs", "block", "pair.i", "pair.j")
    found = work.written(spread.groupBy(*key, "i", "j").applyInArrow(_group(threshold), "id long, links long, low long"), "found")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")), work)
    labelled = classes.join(counts, "id", "left").join(joined, "id", "left")
    labelled = work.written(labelled.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "labelled")
    mine = F.col("vec_id").isNotNull()
    out = every.join(labelled, ["label", "v"], "left")
    return out.select(
        "vec_id",
        F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.coalesce("component", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
