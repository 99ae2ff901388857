"""Language-model scores from a log-frequency Bloom filter of word n-gram counts.

Fitting counts words and word pairs over all training texts in Spark, turns each
count c into the level q = 1 + floor(log_b c), and inserts the pair (n-gram, j)
for every j up to q. A lookup probes j = 1, 2, ... until a probe misses, so a
count costs about ten bits a level and no key is stored. The filter is built in
segments by a grouped job. Scoring broadcasts one wave of segments of bounded size at a
time: each wave adds the levels of its n-grams to the texts' tokens (two bytes a token,
written with the texts where there are several waves) and is destroyed before the next
is sent, so the driver and a worker never hold more than one wave. All bits of
a probe lie in one 64-bit word of its segment, so a probe touches memory once.

A text's probability is the product over its words and one end token of
    p(w | v) = (lo(v, w) + mu * p1(w)) / (hi(v) + mu),
    p1(w)    = (lo(w) + 1) / (N + V + 1),
where lo and hi are the bounds of a level's counts, v is the word before (the end
token at a text's start), and an unseen v leaves p1(w). Rounding down above and up
below keeps the sum over words at 1 or less, apart from the filter's false hits
(about one in a hundred probes of absent n-grams).

Defined results: a null or empty text has one token, the end. Rows with a null id
are scored like others; repeated rows are scored each. With no training rows N and
V are 0 and both scores stay finite; an empty table gives no rows. Ties need no rule.
Columns other than the kept ones and the text are ignored, whatever their names. Texts of
any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace
from clearprose.llm.words import Words, batch_words, mix, signed, slices, unique_sum, unsigned

LEVEL_BASE = 1.5
#: Bits set for an entry, and bits of filter for it.
HASHES = 5
BITS_AN_ENTRY = 11
#: Dirichlet weight of the word model in the pair model.
MU = 50.0
#: Training tokens for each filter segment.
SEGMENT_TOKENS = 1 << 16
#: Bytes of filter that the driver sends and a Python worker holds at a time.
WAVE_BYTES = 64 << 20
#: Most words whose exact counts are broadcast (16 bytes each); rarer ones are joined.
HEAD_WORDS = 1 << 20
#: Distinct keys held before partial counts are sent on.
PARTIAL_KEYS = 1 << 20

END = np.uint64(0x243F6A8885A308D3)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_ONE, _SIX = np.uint64(1), np.uint64(63)
_LEVELS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token after each text, and the bounds by text."""
    return np.insert(words.hashes, words.bounds[1:], END), words.bounds + np.arange(len(words.bounds))


def pair_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word before, word) for each token, and the words before."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return mix(before * _PAIR + tokens), before


def level(counts: np.ndarray) -> np.ndarray:
    q = np.floor(np.log(np.maximum(counts, 1)) / math.log(LEVEL_BASE)).astype(np.int64) + 1
    return q + (_lowest(q + 1) <= counts) - (_lowest(q) > counts)


def _lowest(q: np.ndarray) -> np.ndarray:
    """Smallest count of level q; 0 at level 0."""
    return np.where(q > 0, np.ceil(LEVEL_BASE ** (q - 1.0) - 1e-9), 0.0)


def _highest(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.ceil(LEVEL_BASE**q - 1e-9) - 1, 0.0)


def _probe(keys: np.ndarray, j: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For entries (key, j): the 64-bit word among ``words``, and the bits in it."""
    a = mix(keys ^ _LEVELS[j])
    bits = a * _PAIR >> np.uint64(64 - 6 * HASHES)
    mask = _ONE << (bits & _SIX)
    for i in range(1, HASHES):
        mask |= _ONE << (bits >> np.uint64(6 * i) & _SIX)
    return ((a >> np.uint64(32)) * words >> np.uint64(32)).view(np.int64), mask


def segment_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """One segment's filter: 64-bit words, as many as its entries need."""
    keys, counts = unique_sum(keys, counts)
    q = level(counts)
    data = np.zeros(max(1, -(-int(q.sum()) * BITS_AN_ENTRY // 64)), np.uint64)
    for j in range(1, int(q.max(initial=0)) + 1):
        np.bitwise_or.at(data, *_probe(keys[q >= j], j, np.uint64(len(data))))
    return data.tobytes()


class FilterPart:
    """The segments from ``begin`` to ``end`` of the filter, ready to probe."""

    def __init__(self, begin: int, end: int, table: pa.Table):
        self.begin, self.end = begin, end
        self.size, self.offset, at = np.ones(end - begin, np.uint64), np.zeros(end - begin, np.int64), 0
        numbers, lengths = table["segment"].to_pylist(), pc.binary_length(table["bits"]).to_pylist()
        self.data = np.zeros(max(sum(lengths) // 8, 1), np.uint64)
        for number, length, bits in zip(numbers, lengths, table["bits"], strict=True):
            self.size[number - begin], self.offset[number - begin] = length // 8, at
            self.data[at : at + length // 8] = np.frombuffer(bits.as_buffer(), np.uint64)
            at += length // 8

    def levels(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The level of each key of these segments, 0 where the first probe misses or another wave has the key."""
        q = np.zeros(len(keys), np.uint8)
        alive = np.flatnonzero((segments >= self.begin) & (segments < self.end))
        keys, segments = keys[alive], segments[alive] - self.begin
        size, offset = self.size[segments], self.offset[segments]
        for j in range(1, len(_LEVELS)):
            if not len(alive):
                break
            word, mask = _probe(keys, j, size)
            hit = np.flatnonzero(self.data[offset + word] & mask == mask)
            keys, size, offset, alive = keys[hit], size[hit], offset[hit], alive[hit]
            q[alive] = j
        return q


class Layout:
    """Where keys are stored: word segments first, then pair segments."""

    def __init__(self, n_tokens: int, n_words: int):
        self.words = -(-max(n_words, 1) // SEGMENT_TOKENS)
        self.pairs = -(-max(n_tokens, 1) // SEGMENT_TOKENS)
        self.total = self.words + self.pairs

    def word(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _PAIR) % np.uint64(self.words)).astype(np.int64)

    def pair(self, keys: np.ndarray) -> np.ndarray:
        return self.words + (mix(keys ^ _PAIR) % np.uint64(self.pairs)).astype(np.int64)


def _counted(batches, text: str, keys_of, sent) -> Iterator[pa.RecordBatch]:
    """Distinct keys of the texts with partial counts, as ``sent`` lays them out."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, text):
            segments, keys = keys_of(*tokens_of(batch_words(part, text)))
            if len(keys):
                held.append((segments, keys))
            rows += len(keys)
            if rows >= PARTIAL_KEYS:
                yield sent(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, rows = [], 0
    if held:
        yield sent(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _by_key(_: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    keys, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], ["key", "n"])


def _by_segment(segments: np.ndarray, keys: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each segment: its keys and counts as bytes, so that a grouping moves few rows."""
    keys, first, total = np.unique(keys, return_index=True, return_counts=True)
    counts, segments = (total if counts is None else counts[first]), segments[first]
    order = np.argsort(segments, kind="stable")
    keys, counts, segments = keys[order], counts[order].astype(np.int64), segments[order]
    cuts = np.append(np.flatnonzero(np.append(True, segments[1:] != segments[:-1])), len(keys)).tolist()
    cells = [[x[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)] for x in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array(segments[cuts[:-1]]), *(pa.array(c, pa.binary()) for c in cells)], ["segment", "keys", "counts"])


class LogFrequencyModel:
    """A fitted model: the filter's segments as a table, exact word counts as another."""

    def __init__(self, work: Workspace, words: DataFrame, segments: DataFrame, n_tokens: int, n_words: int, layout: Layout):
        self.work, self.words, self.segments, self.layout = work, words, segments, layout
        self.n_tokens, self.n_words = n_tokens, n_words

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> LogFrequencyModel:
        work = Workspace(docs.sparkSession, "lm")
        texts = docs.select(F.col(text).alias("text"))

        def words_part(batches):
            return _counted(batches, "text", lambda tokens, bounds: (np.zeros(0, np.int64), tokens), _by_key)

        counts = texts.mapInArrow(words_part, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        words = work.written(counts, "words")
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        layout = Layout(total.n, total.v)

        def pairs_part(batches):
            def keys_of(tokens, bounds):
                keys, _ = pair_keys(tokens, bounds)
                return layout.pair(keys), keys

            return _counted(batches, "text", keys_of, _by_segment)

        def placed(batches):
            held, rows = [], 0

            def sent():
                keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                return _by_segment(layout.word(keys), keys, counts)

            for b in batches:
                held.append((unsigned(b.column(0).to_numpy()), b.column(1).to_numpy()))
                rows += b.num_rows
                if rows >= PARTIAL_KEYS:
                    yield sent()
                    held, rows = [], 0
            if rows:
                yield sent()

        def build(table: pa.Table) -> pa.Table:
            keys, counts = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("keys", np.uint64), ("counts", np.int64)))
            return pa.table({"segment": table["segment"][:1].combine_chunks(), "bits": pa.array([segment_bits(keys, counts)], pa.binary())})

        schema = "segment long, keys binary, counts binary"
        entries = texts.mapInArrow(pairs_part, schema).unionByName(words.mapInArrow(placed, schema))
        segments = work.written(entries.groupBy("segment").applyInArrow(build, "segment long, bits binary"), "segments")
        return cls(work, words, segments, total.n, total.v, layout)

    def _ranges(self, wave_bytes: int) -> list[tuple[int, int]]:
        """Ranges of segment numbers whose bits take at most ``wave_bytes`` (a segment is never cut)."""
        is_word = F.col("segment") < self.layout.words
        word, pair = (x or 8 for x in self.segments.agg(F.max(F.when(is_word, F.length("bits"))), F.max(F.when(~is_word, F.length("bits")))).first())
        out, low = [], 0
        while low < self.layout.total:
            room, high = wave_bytes, low
            for longest, end in ((word, self.layout.words), (pair, self.layout.total)):
                more = max(0, min(end - high, room // longest))
                high, room = high + more, room - more * longest
                if high < end:
                    break
            out.append((low, max(high, low + 1)))
            low = out[-1][1]
        return out

    def _sent(self, begin: int, end: int):
        """Broadcast of a range of segments; the driver's own copies end with the call."""
        got = self.segments.filter(F.col("segment").between(begin, end - 1)).toArrow()
        return self.segments.sparkSession.sparkContext.broadcast(FilterPart(begin, end, got))

    def _head(self):
        """Exact counts of the commonest words, and the least count among them."""
        power = F.floor(F.log2("n")).cast("int")
        least, held = 62, 0
        for p, n in sorted(self.words.groupBy(power.alias("p")).count().collect(), reverse=True):
            if held + n > HEAD_WORDS:
                break
            least, held = p, held + n
        got = self.words.filter(F.col("n") >= 1 << least).toArrow()
        keys, counts = unsigned(got["key"].to_numpy()), got["n"].to_numpy().astype(np.int64)
        order = np.argsort(keys)
        return self.segments.sparkSession.sparkContext.broadcast((keys[order], counts[order])), 1 << least

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *kept: str, wave_bytes: int = WAVE_BYTES) -> DataFrame:
        """Each row's kept columns with n_tokens, n_known, base_score and score."""
        head, least = self._head()
        layout, norm = self.layout, float(self.n_tokens + self.n_words + 1)
        ranges = self._ranges(wave_bytes)
        names = [f"k{i}" for i in range(len(kept))]
        measures = ["n_tokens", "n_known", "logs", "score"]
        fields = ["key", "row", "times", *names, *measures]

        def measured(batches, wave) -> Iterator[tuple]:
            """Per slice: its rows, tokens, bounds, and the levels of words and pairs known so far, one byte each."""
            for batch in batches:
                for part in slices(batch, "text"):
                    tokens, bounds = tokens_of(batch_words(part, "text"))
                    distinct, where = np.unique(tokens, return_inverse=True)
                    keys, _ = pair_keys(tokens, bounds)
                    q = np.stack([wave.value.levels(distinct, layout.word(distinct))[where], wave.value.levels(keys, layout.pair(keys))])
                    if "levels" in part.schema.names:
                        column = part.column(part.schema.get_field_index("levels"))
                        q += np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2).T
                    yield part, bounds, distinct, where, q

        def carried(wave):
            def run(batches):
                for part, bounds, _, _, q in measured(batches, wave):
                    cells = [q[:, s:e].T.tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names) + 1], pa.array(cells, pa.binary())], [*names, "text", "levels"])

            return run

        def logs_of(bounds, distinct, where, q) -> np.ndarray:
            """log10 p of every token."""
            before = np.empty_like(where)
            before[1:] = where[:-1]
            before[bounds[:-1]] = np.searchsorted(distinct, END)
            level_of = np.zeros(len(distinct), np.int64)
            level_of[where] = q[0]
            context, pair = _highest(level_of)[before], _lowest(q[1].astype(np.int64))
            p1 = (_lowest(level_of)[where] + 1.0) / norm
            return np.log10(np.where(context > 0, (np.minimum(pair, context) + MU * p1) / (context + MU), p1))

        def finished(wave):
            def run(batches):
                from pyspark import TaskContext

                row = TaskContext.get().partitionId() << 40
                keys, counts = head.value
                for part, bounds, distinct, where, q in measured(batches, wave):
                    starts, n = bounds[:-1], part.num_rows
                    at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                    found = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
                    c = np.where(found, counts[at], 0) if len(keys) else np.zeros(len(distinct), np.int64)
                    logs = np.add.reduceat(np.log10(c + 1.0)[where], starts)
                    known = np.add.reduceat((c > 0).astype(np.int64)[where], starts)
                    score = np.add.reduceat(logs_of(bounds, distinct, where, q), starts)
                    ids = row + np.arange(n, dtype=np.int64)
                    row += n
                    own = [pa.array(signed(mix(ids.view(np.uint64)))), pa.array(ids), pa.array(np.zeros(n, np.int64)), *part.columns[: len(names)]]
                    own += [pa.array(x) for x in (np.diff(bounds), known, logs, score)]
                    yield pa.RecordBatch.from_arrays(own, fields)
                    rare = ~found[where]
                    width = np.int64(len(distinct))
                    pair, times = np.unique(np.repeat(np.arange(n), np.diff(bounds))[rare] * width + where[rare], return_counts=True)
                    if len(pair):
                        blank = [pa.nulls(len(pair), x.type) for x in own[3:]]
                        yield pa.RecordBatch.from_arrays([pa.array(signed(distinct[pair % width])), pa.array(ids[pair // width]), pa.array(times.astype(np.int64)), *blank], fields)

            return run

        types = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, kept, strict=True))
        state = docs.select(*[F.col(c).alias(n) for n, c in zip(names, kept, strict=True)], F.col(text).alias("text"))
        earlier = []
        for begin, end in ranges[:-1]:
            wave = self._sent(begin, end)
            state = self.work.written(state.mapInArrow(carried(wave), f"{types}text string, levels binary"), "levels")
            self.work.drop(*earlier)
            earlier = [state]
            wave.destroy()
        wave = self._sent(*ranges[-1])
        scored = self.work.written(state.mapInArrow(finished(wave), f"key long, row long, times long, {types}n_tokens long, n_known long, logs double, score double"), "scored")
        self.work.drop(*earlier)
        wave.destroy()
        head.destroy()
        rare = self.words.filter(F.col("n") < least).select("key", F.col("n").alias("c"))
        seen = scored.join(rare, "key", "left")
        whole = F.struct(*[F.col(c) for c in [*names, *measures]])
        got = F.col("times") * F.when(F.col("c") > 0, 1).otherwise(0)
        out = seen.groupBy("row").agg(
            F.max(F.when(F.col("times") == 0, F.struct(F.lit(1).alias("own"), whole.alias("w")))).alias("m"),
            F.sum(got).alias("more"),
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more_logs"),
        )
        w = F.col("m.w")
        return out.select(
            *[w[n].alias(c) for n, c in zip(names, kept, strict=True)],
            w["n_tokens"].alias("n_tokens"),
            (w["n_known"] + F.col("more")).alias("n_known"),
            F.lit(self.n_tokens).cast("long").alias("train_tokens"),
            (w["logs"] + F.col("more_logs") - w["n_tokens"] * F.lit(math.log10(norm))).alias("base_score"),
            w["score"].alias("score"),
        )
