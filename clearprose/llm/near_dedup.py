"""Near-duplicate documents by HyperMinHash signatures over 5-word shingles.

A document's shingle hashes are dealt over REGISTERS buckets; a bucket keeps of its
smallest value the count of leading zeros and MANTISSA bits after them. A bucket
without a shingle takes the minimum of all shingles under a hash of its own, so a
register of two documents agrees with about their Jaccard similarity at any size.
Bands of registers are bucket keys; with ROWS registers in each of BANDS bands a pair
at similarity 0.85 shares no bucket with probability 2e-7, at 0.8 with 8e-5.

Documents with equal sets are one class first. A class meets the smallest class of its
buckets (a star, not all pairs); a pair whose collision-corrected estimate allows the
threshold is confirmed on full shingle sets. A second star takes classes that share
a bucket with a larger component to one of its members. What then still lies in a
bucket with another component joins the ball of the bucket's largest component: inside
a ball, blocks of registers are compared across components, and pairs that may be
links are confirmed on full sets, best estimate first, until two components are one.
So all pairs of a bucket are examined unless links already join them, a ball holds a class
once for any number of shared buckets, and no pairs of a group are emitted.

Estimates use the last BITS bits of each register: NIBBLES bytes a class travel, not
the registers. One SLACK standard deviations too low is turned away (about 1e-9).

Defined results: documents without words (null, empty, blank) and rows with a null
id are linked with nothing (their component is their id); repeated rows each get
the same result and cost one row's links; of different texts under one id one is compared and
the others are linked with nothing; ties go to the smaller id;
columns other than the id and text are ignored, whatever their names; an empty table gives
no rows; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from clearprose.llm.graph import components
from clearprose.llm.tables import Workspace
from clearprose.llm.words import batch_words, mix, shingles, signed, slices

ROWS, BANDS = 7, 40
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Last bits of a register that estimates use.
BITS = 4
NIBBLES = REGISTERS * BITS // 8
#: Estimates this many standard deviations under the threshold are turned away.
SLACK = 6.0
THRESHOLD = 80
#: Classes of one side of a comparison inside a ball, and bytes of shingle sets of one.
BLOCK = 1024
BLOCK_BYTES = 8 << 20

_OWN = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND = mix(np.arange(1000, 1000 + ROWS, dtype=np.uint64)) | np.uint64(1)


def document_sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of the hash, and their bounds."""
    h, bounds = shingles(batch_words(part))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(bounds)))


def compress(value: np.ndarray) -> np.ndarray:
    """Registers of 32-bit minima: leading zeros << MANTISSA | bits after the first one."""
    v = value.astype(np.float64)
    exponent = np.where(value > 0, np.frexp(np.maximum(v, 1))[1], 0)  # bits in use
    zeros = 32 - exponent
    rest = np.ldexp(v, MANTISSA - exponent + 1).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (zeros << MANTISSA | np.where(value > 0, rest, 0)).astype(np.uint16)


def registers_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each text; zeros for texts without words."""
    n = len(bounds) - 1
    low = np.full((n, REGISTERS), -1, np.int64)
    if len(h):
        bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        value = (mix(h) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        place = owner * REGISTERS + bucket  # in order, as hashes are
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        low.reshape(-1)[place[first]] = np.minimum.reduceat(value, first)
        for i in np.flatnonzero((low < 0).any(axis=1) & (np.diff(bounds) > 0)):
            empty = np.flatnonzero(low[i] < 0)
            own = h[bounds[i] : bounds[i + 1]]
            for e in range(0, len(empty), max(1, (1 << 22) // len(own))):
                some = empty[e : e + max(1, (1 << 22) // len(own))]
                low[i, some] = ((own[None, :] * _OWN[some][:, None]) >> np.uint64(32)).min(axis=1).astype(np.int64)
    return compress(np.maximum(low, 0))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys."""
    r = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(r.shape[:2], np.uint64)
    for j in range(ROWS):
        key = mix(key + (r[:, :, j] + np.uint64(1)) * _BAND[j])
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))


def nibbles_of(registers: np.ndarray) -> np.ndarray:
    """The last BITS bits of each register, two registers a byte."""
    low = (registers & ((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] << BITS | low[:, 1::2]


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, REGISTERS) last bits of registers."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), NIBBLES)
    out = np.empty((len(column), REGISTERS), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> BITS, packed & ((1 << BITS) - 1)
    return out


def corrected(agree: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers; different minima agree in BITS bits by chance."""
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    t, chance = threshold / 100, 2.0**-BITS
    agree = t + (1 - t) * chance
    return t - SLACK * (agree * (1 - agree) / REGISTERS) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, the nibbles of the registers and the band keys."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = document_sets(part)
                sizes = np.diff(bounds)
                prints = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                    prints.append(mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64)))
                registers = registers_of(h, bounds)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(signed(band_keys(registers).reshape(-1))), BANDS).cast(pa.list_(pa.int64()))
                nibbles = pa.array([r.tobytes() for r in nibbles_of(registers)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), *(pa.array(signed(p)) for p in prints), nibbles, keys], ["doc_id", "n_shingles", "f", "f2", "nibbles", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, f long, f2 long, nibbles binary, bands array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sizes and corrected estimate allow the threshold."""
    least = least_estimate(threshold)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                agree = (unpacked(b.column(2)) == unpacked(b.column(3))).mean(axis=1)
                yield b.select(["a", "b"]).filter(pa.array(corrected(agree) >= least))

    side = lambda c: classes.select(F.col("id").alias(c), F.col("nibbles").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)
    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of wanted and hashes: the whole shingle sets of the documents that it names in id."""
    names = wanted.columns
    types = ", ".join(f"{c} {t}" for c, t in wanted.dtypes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = document_sets(part)
                cells = [h[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(cells, pa.binary())], [*names, "hashes"])

    return docs.join(wanted, "id").select(*names, "text").mapInArrow(run, f"{types}, hashes binary")


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets of hashes have the threshold's similarity."""
    at = np.searchsorted(y, x)
    shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return 100 * shared >= threshold * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, work: Workspace) -> DataFrame:
    """Links among the pairs, by the intersection and union of whole shingle sets."""

    def check(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(*(np.frombuffer(c.as_py(), np.uint64) for c in both), threshold) for both in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = work.written(pairs, "possible")
    # a star's rays travel once, to their centre
    rays = _sets(docs, pairs.select("a", F.col("b").alias("id"))).withColumnRenamed("hashes", "hb")
    centres = _sets(docs, pairs.select(F.col("a").alias("id")).distinct()).withColumnsRenamed({"id": "a", "hashes": "ha"})
    links = work.written(rays.join(centres, "a").select("a", F.col("id").alias("b"), "ha", "hb").mapInArrow(check, "a long, b long"), "links")
    work.drop(pairs)
    return links


def _once(docs: DataFrame, signed_docs: DataFrame, work: Workspace) -> tuple[DataFrame, bool]:
    """``docs`` (id, text) with one row for each id, and whether any id has several; texts move only for those."""
    several = work.written(signed_docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"), "several")
    if several.isEmpty():
        return docs, False
    return docs.join(several, "id", "left_anti").unionByName(docs.join(several, "id", "left_semi").dropDuplicates(["id"])), True


def _keyed(classes: DataFrame) -> DataFrame:
    return classes.withColumn("key", F.explode("bands")).drop("bands")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """id, bands (its keys that other classes have too) and a, the smallest class of their buckets, of each class with such keys."""
    bucket = Window.partitionBy("key")
    met = _keyed(classes.select("id", "bands")).withColumn("a", F.min("id").over(bucket)).withColumn("last", F.max("id").over(bucket)).filter("a < last")
    return met.groupBy("id").agg(F.collect_list("key").alias("bands"), F.min("a").alias("a"))


def _placed(sharing: DataFrame, components_: DataFrame, work: Workspace) -> DataFrame:
    """id, component, the component's size and the shared keys of the classes that share a bucket."""
    placed = sharing.select("id", "bands").join(components_, "id")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    return work.written(placed.join(sizes, "component").select("id", "component", "size", "bands"), "placed")


def _outsiders(placed: DataFrame) -> DataFrame:
    """id, component, and ball and anchor: the largest component of a bucket that isn't the class's own, and a member of it there."""
    order = F.struct("size", "component", (-F.col("id")).alias("anchor"))
    first = F.max(order).over(Window.partitionBy("key"))
    return _keyed(placed).withColumn("m", first).filter("m.component <> component").select("id", "component", F.col("m.component").alias("ball"), (-F.col("m.anchor")).alias("anchor"))


def _blocked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of a ball once for each group (ball, i, j): added rows are on side i, all rows on side j."""
    own = F.pmod(F.xxhash64("id"), F.when(F.col("added"), F.col("na")).otherwise(F.col("nc"))).cast("int")
    placed = rows.join(blocks, "ball").withColumn("block", own)
    struct = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine = F.col("block")
    # groups j < na hold added rows on side j, the others core rows
    as_j = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: struct(i, F.when(F.col("added"), mine).otherwise(mine + F.col("na"))))
    as_j = F.when(F.col("added"), F.filter(as_j, lambda p: p["i"] <= p["j"])).otherwise(as_j)
    as_i = F.transform(F.sequence(mine, F.col("na") + F.col("nc") - 1), lambda j: struct(mine, j))
    pairs = F.when(F.col("added"), F.array_distinct(F.concat(as_i, as_j))).otherwise(as_j)
    return placed.withColumn("p", F.explode(pairs)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group on its two sides."""
    added, block = group["added"].to_numpy(), group["block"].to_numpy()
    i, j, na = (group[c][0].as_py() for c in ("i", "j", "na"))
    return np.flatnonzero(added & (block == i)), np.flatnonzero(added & (block == j) if j < na else ~added & (block == j - na))


def _near(group: pa.Table, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x, y of both sides in different components whose estimate allows the threshold, and the estimates."""
    x, y = _sides(group)
    least, nibbles = least_estimate(threshold), unpacked(group["nibbles"])
    component, n = group["component"].to_numpy(), group["n_shingles"].to_numpy().astype(float)
    for at in range(0, len(x), 32):
        some = x[at : at + 32]
        fits = (component[some][:, None] != component[y]) & (np.minimum(n[some][:, None], n[y]) * 100 >= threshold * np.maximum(n[some][:, None], n[y]))
        columns = np.flatnonzero(fits.any(axis=0))
        estimate = corrected((nibbles[some][:, None, :] == nibbles[y[columns]][None, :, :]).mean(axis=2))
        r, c = np.nonzero((estimate >= least) & fits[:, columns])
        yield some[r], y[columns[c]], estimate[r, c]


def _flagged(threshold: int):
    """Members of a block pair that may have a link across components."""

    def found(group: pa.Table) -> pa.Table:
        rows = [np.zeros(0, np.int64)]
        for x, y, _ in _near(group, threshold):
            rows += [x, y]
        return group.select(["ball", "id", "component", "added"]).take(pa.array(np.unique(np.concatenate(rows))))

    return found


def _block_links(threshold: int):
    """A link for each two components of a block pair that links join, found best estimate first."""

    def found(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"].to_pylist()]
        names, component = np.unique(group["component"].to_numpy(), return_inverse=True)
        root = list(range(len(names)))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y, estimate in _near(group, threshold):
            for k in np.argsort(-estimate, kind="stable").tolist():
                a, b = top(component[x[k]]), top(component[y[k]])
                if a != b and linked(sets[x[k]], sets[y[k]], threshold):
                    root[a] = b
                    out.append((names[component[x[k]]], names[component[y[k]]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return found


def _ball_links(outsiders: DataFrame, components_: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, work: Workspace) -> DataFrame:
    """Links (between component names) of outsiders with anything in their balls."""
    added = work.written(outsiders.select("ball", "id", "component").distinct(), "added")
    told = classes.select("id", "n_shingles", "nibbles")
    balls = added.select("ball").distinct()
    core = components_.join(balls, components_["component"] == balls["ball"]).select("ball", "id", "component")
    rows = added.withColumn("added", F.lit(True)).unionByName(core.withColumn("added", F.lit(False)))
    rows = work.written(rows.join(told, "id"), "balls")

    def dealt(rows: DataFrame, weight, most: int) -> DataFrame:
        count = lambda kind: F.greatest(F.ceil(F.sum(F.when(kind, weight)) / most), F.lit(1)).cast("int")
        blocks = rows.groupBy("ball").agg(F.coalesce(count(F.col("added")), F.lit(0)).alias("na"), F.coalesce(count(~F.col("added")), F.lit(0)).alias("nc"))
        return _blocked(rows, blocks.filter("na > 0"))

    near = dealt(rows, F.lit(1), BLOCK).groupBy("ball", "i", "j").applyInArrow(_flagged(threshold), "ball long, id long, component long, added boolean").distinct()
    near = work.written(near, "near")
    table = work.written(_sets(docs, near.select("id").distinct()), "sets")
    whole = near.join(table.dropDuplicates(["id"]), "id").join(told, "id")
    spread = dealt(whole, F.length("hashes"), BLOCK_BYTES)
    return work.written(spread.groupBy("ball", "i", "j").applyInArrow(_block_links(threshold), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``threshold`` in hundredths."""
    work = Workspace(docs.sparkSession, "near")
    signed_docs = work.written(signatures(docs, doc_id, text), "signatures")
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    usable = signed_docs.filter("doc_id is not null and n_shingles > 0")
    own, repeated = _once(own, signed_docs, work)
    same = ["f", "f2", "n_shingles"]
    classes = usable.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("nibbles").alias("nibbles"), F.first("bands").alias("bands"))
    if repeated:  # rows of one id whose texts differ: one of them stands for the id
        classes = classes.groupBy("id").agg(F.min_by(F.struct(*same, "nibbles", "bands"), F.struct(*same)).alias("c")).select("id", "c.*")
    classes = work.written(classes, "classes")

    sharing = work.written(_shared_keys(classes).join(classes.select("id", "n_shingles", "nibbles"), "id"), "sharing")

    def labelled(links: DataFrame) -> DataFrame:
        """id and component of every class that shares a bucket."""
        joined = sharing.select("id").join(components(links, work), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        return work.written(joined, "labelled")

    stars = sharing.filter("a < id").select("a", F.col("id").alias("b"))
    links = _confirmed(_possible(stars, sharing, threshold), own, threshold, work)
    found = labelled(links)
    second = _outsiders(_placed(sharing, found, work)).groupBy(F.col("id").alias("b")).agg(F.min("anchor").alias("a"))
    links = links.unionByName(_confirmed(_possible(second.select("a", "b"), sharing, threshold), own, threshold, work))
    found = labelled(links)
    merged = _ball_links(_outsiders(_placed(sharing, found, work)), found, sharing, own, threshold, work)
    found = labelled(links.unionByName(merged))

    named = classes.select(*same, "id").join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = signed_docs.select("doc_id", *same).join(named, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
