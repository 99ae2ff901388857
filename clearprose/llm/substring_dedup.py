"""Repeated passages across documents by compact windows of shingle min-hashes.

Under each of FUNCTIONS hashes, the compact window of a shingle is the widest run of
a text's shingles in which it is the smallest: a Cartesian tree of the values has
these windows as its nodes, and only nodes of at least WINDOW shingles are kept
(about 2 n / WINDOW for n shingles). Texts that share a passage of WINDOW shingles
share the smallest shingle of it, and so a window key, under every hash, and texts
with a passage of Jaccard similarity J under about J of the hashes. Each key's
windows are paired with the key's smallest document (a star, not all pairs). Windows
whose words no passage covers after that are keyed anew by all runs of SEED_WORDS words of
the passages around their pivots, and meet the smallest document with that run; what is still
uncovered meets the smallest document with one of its runs of MIN_WORDS words, so exact
passages are always found.
A first pair of
documents is a candidate where the windows of at least HITS hashes meet in a stretch of
WINDOW shingles; it is verified on the words of both: exact runs on the candidate's
diagonals are chained over small gaps, and a chain of at least MIN_WORDS words with
shingle similarity of at least SIMILARITY, or a single exact run of that length,
is a repeated passage of the larger document. Words are compared by 32-bit hashes.

Defined results: texts without MIN_WORDS words (null and empty ones too) and rows
with a null id have no passages; rows of one id count as one document, of texts that differ
the smallest (``without_passages`` takes one text an id); a passage
repeated only inside one document is none; ties go to the smaller id; other columns,
whatever their names, are ignored (kept by ``without_passages``); an empty table gives no
rows; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace, free_names, once
from clearprose.llm.words import SHINGLE, batch_words, mix, shingles, signed, slices, text_bytes, words_of

MIN_WORDS = 50
WINDOW = MIN_WORDS - SHINGLE + 1
FUNCTIONS, HITS = 5, 2
SIMILARITY = 0.8
#: An exact run of so many words is in a passage of MIN_WORDS words and SIMILARITY, unless lines repeat inside it.
SEED_WORDS = 24
#: Shingles of reach kept on each side of a pivot; a window's further shingles have windows of other pivots' keys.
REACH = (1 << 16) - 1
#: Words that may differ between two exact runs of one passage.
GAP = 12
#: Words or pairs of places that verification holds at once.
_BLOCK = 1 << 20

_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def compact_windows(s: np.ndarray, width: int = WINDOW, bounds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(function, key, pivot, left, right) of all compact windows of at least ``width`` shingles; text i of several has s[bounds[i]:bounds[i+1]]."""
    n = len(s)
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty.view(np.uint64), empty, empty, empty
    bounds = np.array([0, n]) if bounds is None else bounds
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    values = mix(s[None, :] ^ _SEEDS[:, None])
    bits = np.uint64(max(1, n.bit_length()))
    least = (values >> bits << bits) | np.arange(n, dtype=np.uint64)[None, :]
    span = 1
    while span < width:  # minima over runs of ``width``
        step = min(span, width - span)
        least = np.minimum(least[:, : least.shape[1] - step], least[:, step:])
        span += step
    fresh = np.ones(least.shape, bool)
    fresh[:, 1:] = least[:, 1:] != least[:, :-1]
    fresh[:, bounds[:-1][np.diff(bounds) >= width]] = True
    fresh &= owner[: n - width + 1] == owner[width - 1 :]
    function, at = np.nonzero(fresh)
    rank = least[function, at]
    pivot = (rank & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    left, right = bounds[owner[at]], bounds[owner[at] + 1] - 1
    # the tree's nodes in text order; a stack of rising values gives each node's reach
    stack: list[tuple[int, int, int]] = []
    now = -1
    for i, (g, r, p) in enumerate(zip((function * len(bounds) + owner[at]).tolist(), rank.tolist(), pivot.tolist(), strict=True)):
        if g != now:
            now, stack = g, []
        while stack and stack[-1][1] > r:
            right[stack.pop()[0]] = p - 1
        if stack:
            left[i] = stack[-1][2] + 1
        stack.append((i, r, p))
    return function, values[function, pivot], pivot, left, right


def windows_of(docs: DataFrame) -> DataFrame:
    """key, doc_id and place (pivot, reach to the left and to the right, hash number) of each window."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = shingles(batch_words(part))
                f, key, pivot, left, right = compact_windows(h, WINDOW, bounds)
                if len(key):
                    doc = np.searchsorted(bounds, pivot, "right") - 1
                    reach = [np.minimum(x, REACH) for x in (pivot - left, right - pivot)]
                    place = (pivot - bounds[doc]) << 35 | reach[0] << 19 | reach[1] << 3 | f
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), part.column(0).take(pa.array(doc)), pa.array(place)], ["key", "doc_id", "place"])

    return docs.mapInArrow(run, "key long, doc_id long, place long")


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    pivot = place >> 35
    return pivot, pivot - (place >> 19 & 0xFFFF), pivot + (place >> 3 & 0xFFFF), place & 7


def meeting_pivots(place: np.ndarray) -> np.ndarray:
    """Pivots of the windows that meet windows of HITS hashes in all in a stretch of WINDOW shingles."""
    pivot, left, right, function = _unpacked(place)
    hits = np.zeros(len(pivot), np.int64)
    for f in range(FUNCTIONS):
        some = np.flatnonzero(function == f)
        if len(some):
            some = some[np.argsort(left[some])]
            # windows have at least WINDOW shingles each: two share as many where each begins so far before the other's end
            before = np.searchsorted(left[some], right - (WINDOW - 1), "right")
            reach = np.maximum.accumulate(right[some])
            hits += (before > 0) & (reach[np.maximum(before, 1) - 1] >= left + WINDOW - 1)
    return np.unique(pivot[hits >= HITS])


def _grams(w: np.ndarray) -> np.ndarray:
    out = w[: len(w) - SHINGLE + 1].astype(np.uint64)
    for j in range(1, SHINGLE):
        out = out * _STEP + w[j : len(w) - SHINGLE + 1 + j]
    return mix(out)


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the rows with at most ``most`` in all, or a single larger one."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, as many as its size."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _runs(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """start, end and shift of maximal runs a[i] == b[i - shift] of at least SHINGLE words, in order."""
    low, high = np.maximum(0, shifts), np.minimum(len(a), len(b) + shifts)
    found = [np.zeros((3, 0), np.int64)]
    for some in _blocks(high - low + 1, _BLOCK):
        sizes = high[some] - low[some] + 1  # a slot that is never the same comes before each diagonal
        offset = np.cumsum(sizes) - sizes
        same = np.zeros(int(sizes.sum()) + 1, bool)
        for o, s, e, d in zip(offset.tolist(), low[some].tolist(), high[some].tolist(), shifts[some].tolist(), strict=True):
            np.equal(a[s:e], b[s - d : e - d], out=same[o + 1 : o + 1 + e - s])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2]
        long = end - start >= SHINGLE
        start, end = start[long], end[long]
        k = np.searchsorted(offset, start, "right") - 1
        base = low[some][k] - offset[k]
        found.append(np.stack([start + base, end + base, shifts[some][k]]))
    runs = np.concatenate(found, axis=1)
    return runs[:, np.lexsort(runs[::-1])]


def _diagonals(ga: np.ndarray, pivots: np.ndarray, index: tuple[np.ndarray, ...]) -> np.ndarray:
    """Every p - q of a pivot p and a place q of the same shingle in b."""
    gb, order, by = index
    pivots = pivots[(pivots >= 0) & (pivots < len(ga))].astype(np.int64)
    first = np.searchsorted(by, ga[pivots], "left")
    sizes = np.searchsorted(by, ga[pivots], "right") - first
    found = np.zeros(len(ga) + len(gb), bool)
    for some in _blocks(sizes, _BLOCK):
        found[np.repeat(pivots[some], sizes[some]) - order[_spread(first[some], sizes[some])] + len(gb)] = True
    return np.flatnonzero(found) - len(gb)


def _chains(runs: np.ndarray) -> list[np.ndarray]:
    """Chains of two or more runs: each run in order of start follows the run of the best chain that ends close before it, in both texts."""
    start, end, shift = runs
    begin_b, end_b = start - shift, end - shift
    order = np.argsort(end_b, kind="stable")
    by = end_b[order]
    first = np.searchsorted(by, begin_b - GAP, "left")
    sizes = np.searchsorted(by, begin_b + SHINGLE, "right") - first
    score, ends, before, followed = (end - start).tolist(), end.tolist(), [-1] * len(start), [False] * len(start)
    for some in _blocks(sizes, _BLOCK):
        k = np.repeat(np.arange(len(start))[some], sizes[some])
        i = order[_spread(first[some], sizes[some])]
        near = (i < k) & (end[i] >= start[k] - GAP) & (end[i] < end[k]) & (end_b[i] < end_b[k])
        k, i = k[near], i[near]
        at = np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(k)).tolist()
        ks, other, starts = k.tolist(), i.tolist(), start[k].tolist()
        for x, y in zip(at[:-1], at[1:], strict=True):
            s, best, most = starts[x], -1, 0
            for j in other[x:y]:
                worth = score[j] - max(0, ends[j] - s)
                if best < 0 or worth > most:
                    best, most = j, worth
            score[ks[x]] += most
            before[ks[x]], followed[best] = best, True
    out = []
    for k in range(len(start)):
        if before[k] >= 0 and not followed[k]:
            chain, i = [], k
            while i >= 0:
                chain.append(i)
                i = before[i]
            out.append(np.array(chain[::-1]))
    return out


def _similar_parts(ga: np.ndarray, gb: np.ndarray, chain: np.ndarray) -> list[tuple[int, int, int, float]]:
    """From each run of the chain on, the longest part of at least MIN_WORDS words and SIMILARITY, by sets of shingles."""
    start, end, shift = chain
    t, u = start - shift, end - shift
    if end[-1] - start[0] < MIN_WORDS:
        return []
    k, size = len(start), int(end[-1] - start[0]) - SHINGLE + 1
    number = np.unique(np.concatenate([ga[start[0] : end[-1] - SHINGLE + 1], gb[t[0] : u[-1] - SHINGLE + 1]]), return_inverse=True)[1]
    times = np.bincount(number)
    lone = np.append(0, np.cumsum(times[number] == 1))  # shingles that are nowhere else, before each place
    sides = []
    for ids, begin, last, before in ((number[:size], start - start[0], end - start[0] - SHINGLE, lone[: size + 1]), (number[size:], t - t[0], u - t[0] - SHINGLE, lone[size:])):
        sides.append((ids, begin, last, before[begin], before[last + 1]))
    (_, begin_a, last_a, low_a, high_a), (_, begin_b, last_b, low_b, high_b) = sides
    found, reached = [], -1
    for i in range(min(k - 1, int(np.count_nonzero(end[-1] - start >= MIN_WORDS)))):
        # no part is more similar than it would be without repeats and with all shingles but the lone ones shared
        n, m, x, y = last_a - begin_a[i] + 1, last_b - begin_b[i] + 1, high_a - low_a[i], high_b - low_b[i]
        may = (n - x >= SIMILARITY * (n + y) - 1e-6) & (m - y >= SIMILARITY * (m + x) - 1e-6) & (end - start[i] >= MIN_WORDS) & (u - t[i] >= SHINGLE)
        if not may[max(i, reached) + 1 :].any():
            continue
        since = []  # for each shingle, the run with which it is first in the part
        for ids, begin, last, _, _ in sides:
            first = np.full(len(times), len(number), np.int64)
            places = np.arange(len(ids) - 1, begin[i] - 1, -1)
            first[ids[places]] = places
            since.append(np.searchsorted(last, first))
        n, m, shared = (np.cumsum(np.bincount(x, minlength=k + 1)[:k]) for x in (*since, np.maximum(*since)))
        good = np.flatnonzero(may & (shared / np.maximum(1, n + m - shared) >= SIMILARITY))
        if len(good) and good[-1] > max(i, reached):
            reached = int(good[-1])
            similarity = shared[reached] / max(1, n[reached] + m[reached] - shared[reached])
            found.append((int(start[i]), int(end[reached]), int(t[i]), float(similarity)))
    return found


def _indexed(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """A text's shingles, their order by value, and the values in it."""
    gb = _grams(b)
    order = np.argsort(gb)
    return gb, order, gb[order]


def verified(a: np.ndarray, b: np.ndarray, pivots: np.ndarray, index: tuple[np.ndarray, ...] | None = None) -> list[tuple[int, int, int, float]]:
    """(start, end, start in b, similarity) of the passages of a that b repeats around the pivots, without those inside another."""
    if len(a) < MIN_WORDS or len(b) < MIN_WORDS:
        return []
    ga, index = _grams(a), index or _indexed(b)
    shifts = _diagonals(ga, pivots, index)
    if len(a) == len(b) and (shifts == 0).any() and np.array_equal(a, b):
        return [(0, len(a), 0, 1.0)]  # every other passage is inside it
    runs = _runs(a, b, shifts)
    exact = runs[:, runs[1] - runs[0] >= MIN_WORDS]
    found = [(s, e, s - d, 1.0) for s, e, d in exact.T.tolist()]
    chains = _chains(runs)
    within = _inside(np.array([runs[0, c[0]] for c in chains], np.int64), np.array([runs[1, c[-1]] for c in chains], np.int64), exact[:2].T)
    for chain, inside in zip(chains, within.tolist(), strict=True):
        if not inside:
            found += _similar_parts(ga, index[0], runs[:, chain])
    out, reached = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if x[1] > reached:
            out.append(x)
            reached = x[1]
    return out


def _span(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the stretches of MIN_WORDS words around each pivot in its window."""
    pivot, left, right, _ = _unpacked(place)
    return np.maximum(left, pivot - WINDOW + 1), np.minimum(np.minimum(pivot, right - WINDOW + 1), n - MIN_WORDS)


def _inside(low: np.ndarray, high: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether the words from low to high lie inside one span (start, end)."""
    if not len(spans):
        return np.zeros(len(low), bool)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    k = np.searchsorted(spans[:, 0], low, "right") - 1
    return (k >= 0) & (reach[np.maximum(k, 0)] >= high)


def _hashed(w: np.ndarray, size: int) -> np.ndarray:
    out, have = w, 1
    for bit in bin(size)[3:]:  # runs of have words, then of twice as many, and one more where the bit says so
        out = out[: len(out) - have] * np.uint64(pow(int(_STEP), have, 1 << 64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * _STEP + w[have:]
            have += 1
    return mix(out ^ np.uint64(size))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, source_doc_id, source_start_word and similarity of each repeated passage."""
    work = Workspace(docs.sparkSession, "passages")
    own = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    repeated = work.written(own.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        own = once(own, "doc_id", repeated)
    shared = work.written(_starred(windows_of(own), "key", F.lit(True)), "shared")
    met = shared.filter("doc_id <> source").groupBy("doc_id", "source").agg(F.collect_set("place").alias("places"))
    enough = F.size(F.array_distinct(F.transform("places", lambda p: p.bitwiseAND(7)))) >= HITS

    def meeting(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [meeting_pivots(x.values.to_numpy()) for x in b.column(2)]
            keep = np.array([len(c) > 0 for c in cells], bool)
            pivots = pa.array([c.astype(np.int32).tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pivots], ["doc_id", "source", "pivots"]).filter(pa.array(keep))

    pairs = work.written(met.filter(enough).mapInArrow(meeting, "doc_id long, source long, pivots binary"), "pairs")
    found = _checked(pairs, own, work)

    # windows whose words no passage covers yet may have met only a smaller document that has their key, not their passage
    places = shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"), F.collect_list("place").alias("places"), F.collect_list(F.col("doc_id") == F.col("source")).alias("owned"))

    def marked(batches) -> Iterator[pa.RecordBatch]:
        """Every shared window, and whether it waits: uncovered, of a document that isn't its key's smallest."""
        for b in batches:
            for doc, keys, places, owned, spans in zip(*(b.column(i) for i in range(5)), strict=True):
                place = places.values.to_numpy()
                low, high = _span(place, 1 << 40)
                waits = ~owned.values.to_numpy(zero_copy_only=False) & ~_inside(low, high + MIN_WORDS, _pairs_of(spans))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.full(len(place), doc.as_py())), places.values, pa.array(waits)], ["key", "doc_id", "place", "waits"])

    told = places.join(_spans(found), "doc_id", "left").select("doc_id", "keys", "places", "owned", "spans").mapInArrow(lambda batches: _gathered(marked(batches)), "key long, doc_id long, place long, waits boolean")
    open_ = told.withColumn("open", F.max("waits").over(Window.partitionBy("key"))).filter("open")
    again = open_.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    seeds = again.join(_spans(found), "doc_id", "left").join(own, "doc_id").select("doc_id", "places", "spans", "text").mapInArrow(_seed_runs, RUN)
    shared_runs = work.written(_starred(seeds, "run", ~F.col("covered")), "runs")
    work.drop(shared)
    found = found.unionByName(_checked(_met_runs(shared_runs, work), own, work))

    # the same for what that left: every run of MIN_WORDS around a shared run, so the smallest document with it repeats the passage
    held = shared_runs.groupBy("doc_id").agg(F.collect_list("run").alias("runs"), F.collect_list("at").alias("places"))
    left = held.join(_spans(found), "doc_id", "left").select("doc_id", "runs", "places", "spans").mapInArrow(_marked, RUN)
    still = work.written(_starred(left, "run", ~F.col("covered")), "still")
    work.drop(shared_runs)
    around = still.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    whole = around.join(_spans(found), "doc_id", "left").join(own, "doc_id").select("doc_id", "places", "spans", "text").mapInArrow(_whole_runs, RUN)
    pairs = _met_runs(_starred(whole, "run", ~F.col("covered")), work)
    work.drop(still)
    every = found.unionByName(_checked(pairs, own, work))
    return every.groupBy("doc_id").applyInArrow(_outermost, every.schema)


RUN = "run long, doc_id long, at int, size int, covered boolean"


def _starred(rows: DataFrame, key: str, waiting: Column) -> DataFrame:
    """The rows with source, the key's smallest document, of keys for which another document is waiting."""
    bucket = Window.partitionBy(key)
    both = rows.withColumn("source", F.min("doc_id").over(bucket)).withColumn("last", F.max(F.when(waiting, F.col("doc_id"))).over(bucket))
    return both.filter("source < last").drop("last")


def _spans(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))


def _marked(batches) -> Iterator[pa.RecordBatch]:
    """The runs of SEED_WORDS words of each document, marked where spans cover all passages of MIN_WORDS words with them."""
    size, margin = SEED_WORDS, MIN_WORDS - SEED_WORDS
    for b in batches:
        for doc, runs, places, spans in zip(*(b.column(i) for i in range(4)), strict=True):
            at = places.values.to_numpy()
            covered = _inside(np.maximum(0, at - margin), at + size + margin, _pairs_of(spans))
            columns = [runs.values, pa.array(np.full(len(at), doc.as_py())), places.values, pa.array(np.full(len(at), size, np.int32)), pa.array(covered)]
            yield pa.RecordBatch.from_arrays(columns, ["run", "doc_id", "at", "size", "covered"])


def _runs_of(h: np.ndarray, doc: int, at: np.ndarray, size: int, spans: np.ndarray) -> pa.RecordBatch:
    margin = MIN_WORDS - size
    covered = _inside(np.maximum(0, at - margin), np.minimum(len(h), at + size + margin), spans)
    columns = [pa.array(signed(_hashed(h, size)[at])), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(covered)]
    return pa.RecordBatch.from_arrays(columns, ["run", "doc_id", "at", "size", "covered"])


def _texts_with_places(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Document, its word hashes, places and spans."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = batch_words(part)
            for i in range(part.num_rows):
                yield part.column(0)[i].as_py(), w.hashes[w.bounds[i] : w.bounds[i + 1]], part.column(1)[i].values.to_numpy(), _pairs_of(part.column(2)[i])


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for x in parts:
        held.append(x)
        rows += x.num_rows
        if rows >= 1 << 16:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """All places below n in the closed ranges."""
    steps = np.zeros(max(n, int(high.max(initial=0)) + 1) + 1, np.int64)
    np.add.at(steps, low, 1)
    np.add.at(steps, high + 1, -1)
    return np.flatnonzero(np.cumsum(steps)[: max(n, 0)])


def _seed_runs(batches) -> Iterator[pa.RecordBatch]:
    """The runs of SEED_WORDS words of all passages of MIN_WORDS words around each pivot in its window."""

    def parts():
        for doc, h, places, spans in _texts_with_places(batches):
            low, high = _span(places, len(h))
            some = low <= high
            at = _starts(low[some], high[some] + MIN_WORDS - SEED_WORDS, len(h) - SEED_WORDS + 1)
            if len(at):
                yield _runs_of(h, doc, at, SEED_WORDS, spans)

    return _gathered(parts())


def _whole_runs(batches) -> Iterator[pa.RecordBatch]:
    """All runs of MIN_WORDS words that hold one of the runs of SEED_WORDS words at the places."""

    def parts():
        for doc, h, places, spans in _texts_with_places(batches):
            at = _starts(np.maximum(places - (MIN_WORDS - SEED_WORDS), 0), places, len(h) - MIN_WORDS + 1)
            if len(at):
                yield _runs_of(h, doc, at, MIN_WORDS, spans)

    return _gathered(parts())


def _met_runs(shared: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, source and pivots at both ends of the uncovered runs that the source has too."""

    def packed(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for x in b.column(2):
                at, size = (x.values.field(k).to_numpy().astype(np.int32) for k in (0, 1))
                cells.append(np.unique(np.concatenate([at, at + size - SHINGLE])).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], ["doc_id", "source", "pivots"])

    met = shared.filter("not covered and doc_id <> source").groupBy("doc_id", "source").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    return work.written(met.mapInArrow(packed, "doc_id long, source long, pivots binary"), "pairs")


def _pairs_of(spans: pa.Scalar) -> np.ndarray:
    """start_word and end_word of a list of spans; null is empty."""
    if not spans.is_valid:
        return np.zeros((0, 2), np.int64)
    values = spans.values
    return np.stack([values.field(0).to_numpy(), values.field(1).to_numpy()], axis=1).astype(np.int64)


def _checked(pairs: DataFrame, own: DataFrame, work: Workspace) -> DataFrame:
    """The passages of pairs (doc_id, source, pivots), a written table that goes with the word arrays once they are found."""
    involved = work.written(pairs.select("doc_id").unionByName(pairs.select(F.col("source").alias("doc_id"))).distinct(), "involved")

    def spelled(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = batch_words(part)
                short = w.hashes.astype(np.uint32)
                cells = [short[s:e].tobytes() for s, e in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], ["doc_id", "words"])

    words = work.written(own.join(involved, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(spelled, "doc_id long, words binary"), "words")
    side = lambda c, w: words.select(F.col("doc_id").alias(c), F.col("words").alias(w))

    def check(batches) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start_word", "similarity"]
        known, index = None, None
        for batch in batches:
            rows = []
            for d, source, pivots, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                b = np.frombuffer(b, np.uint32)
                if source != known and len(b) >= MIN_WORDS:  # rows of one source follow one another
                    known, index = source, _indexed(b)
                for s, e, t, similarity in verified(np.frombuffer(a, np.uint32), b, np.frombuffer(pivots, np.int32), index):
                    rows.append((d, s, e, source, t, similarity))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    both = pairs.join(side("doc_id", "a"), "doc_id").join(side("source", "b"), "source").select("doc_id", "source", "pivots", "a", "b")
    found = work.written(both.mapInArrow(check, "doc_id long, start_word int, end_word int, source_doc_id long, source_start_word int, similarity double"), "found")
    work.drop(pairs, words, involved)
    return found


def _outermost(group: pa.Table) -> pa.Table:
    """A document's passages without those inside another; of equal ones the smallest source stays."""
    group = group.sort_by([("start_word", "ascending"), ("end_word", "descending"), ("source_doc_id", "ascending"), ("source_start_word", "ascending")])
    ends = group["end_word"].to_numpy()
    before = np.maximum.accumulate(np.append(-1, ends[:-1]))
    return group.filter(pa.array(ends > before))


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table's rows with the passages cut from the text; rows that lose all their words are dropped."""
    Workspace(docs.sparkSession, "passages")
    of, named = free_names(docs.columns, "of", "cuts")
    cuts = passages.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(named))
    marked = docs.join(cuts, F.col(doc_id) == F.col(of), "left").drop(of)
    at_text, names = docs.columns.index(text), docs.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, cut = batch.column(at_text), batch.column(len(names))
            texts, keep = column.to_pylist(), np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False)).tolist():
                blob, origins = text_bytes(column.slice(i, 1))
                w = words_of(blob, origins)
                gone = np.zeros(len(w.starts), bool)
                for c in cut[i].as_py():
                    gone[c["start_word"] : c["end_word"]] = True
                keep[i] = not gone.all()
                edges = np.append(w.starts, len(blob))  # a word goes with the space after it
                stay = np.ones(len(blob), bool)
                for k in np.flatnonzero(gone).tolist():
                    stay[edges[k] : edges[k + 1]] = False
                texts[i] = blob[stay].tobytes().decode()
            columns = [batch.column(k) if k != at_text else pa.array(texts, column.type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return marked.mapInArrow(run, docs.schema)
