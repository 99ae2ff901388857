"""Byte-level BPE: Spark higher-order functions fold ranked merges over distinct words.

The ranks become two literal arrays, the rows of a table of all pairs of symbols
whose concatenation has a rank laid into each other's gaps (a flat map literal is
searched from end to end for each look-up). One expression then folds merges over a word's array of
byte symbols: it keeps the ranks of all adjacent pairs and, step by step, replaces
the leftmost pair of the lowest rank.

Every word is folded once. Texts are read once: a slice of them becomes a row of its distinct
words and of unit numbers for its texts (a unit is a word with its space, mostly). The words of all
slices are sorted together, each is folded for all slices that have it, and its ids go back to
them in blocks; the ids of a text are then taken by its unit numbers. Words longer than FOLD_BYTES,
for which a quadratic fold is too slow, are merged by the ragged arrays of
``ragged_bpe`` with the same ranks. Decoding concatenates the ids' byte pieces.

Defined results: a null or empty text has no ids (the digests are of empty bytes).
Every row is encoded, repeated ones and ones with a null id too; texts are never
cut. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose.llm.ragged_bpe import PairTable, merge_all
from clearprose.llm.tables import Workspace
from clearprose.llm.words import slices, text_bytes

#: Longer words are merged by ragged arrays.
FOLD_BYTES = 128
#: Bytes of text that share a row of words and unit numbers; a longer single text has its own.
SLICE = 32 << 20
#: Word places held before they are sent to their slices.
PLACES = 1 << 20
#: Units of texts whose ids are laid out at once.
UNITS = 1 << 19

#: In place of a unit's number: it comes for the first time, or is rarer and told apart.
_FIRST, _RARE = 255, 254
_RANK_BITS = 16
_NO_RANK = 1 << _RANK_BITS
#: Places looked at together when a row of the pair table is laid.
_PLACES = 4096
#: Bytes that may begin white space.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

# Cutting before every space may cut a run of white space where a space has more of it behind: such texts are matched whole.
_IN_A_RUN = re.compile(r" \s")


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@lru_cache(2)
def pairs_of(path: str) -> np.ndarray:
    """Rows (left, right, rank) of all pairs whose concatenation has a rank."""
    ranks = read_ranks(path)
    return np.array([(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks], np.int64)


@lru_cache(2)
def pair_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each left symbol's row starts, and the rows (left << 16 | rank at start + right), laid into each other's gaps."""
    left, right, rank = pairs_of(path).T
    top = int(max(left.max(initial=0), right.max(initial=0), rank.max(initial=0)))
    if top >= _NO_RANK - 1:
        raise ValueError("the vocabulary has more than 65,535 ranks")
    order = np.argsort(left, kind="stable")
    bounds = np.searchsorted(left[order], np.arange(top + 2))
    start, entries, free = np.zeros(top + 1, np.int64), np.full(len(left) + top + 1, -1, np.int64), np.ones(len(left) + 2 * top + _PLACES, bool)
    size, low = 0, 0
    for row in np.argsort(-np.diff(bounds), kind="stable").tolist():
        mine = order[bounds[row] : bounds[row + 1]]
        if not len(mine):
            break
        size, low = len(mine), low if len(mine) == size else 0
        while True:
            if low + _PLACES + top >= len(free):
                free = np.append(free, np.ones(len(free), bool))
            fits = np.ones(_PLACES, bool)
            for r in right[mine].tolist():
                fits &= free[low + r : low + r + _PLACES]
                if not fits.any():
                    break
            if fits.any():
                break
            low += _PLACES
        low += int(fits.argmax())
        at = low + right[mine]
        if at.max() >= len(entries):
            entries = np.append(entries, np.full(len(entries), -1, np.int64))
        start[row], free[at], entries[at] = low, False, left[mine] << _RANK_BITS | rank[mine]
    used = int(np.flatnonzero(entries >= 0).max(initial=0)) + 1
    return start.astype(np.int32), entries[:used].astype(np.uint32).view(np.int32)


def _literal(values: np.ndarray) -> Column:
    return F.expr("cast(split('" + ",".join(map(str, values.tolist())) + "', ',') as array<int>)")


def fold_merges(symbols: Column, path: str) -> Column:
    """Ids of a word from its array of byte symbols (array<int>)."""
    start, entries = pair_arrays(path)
    table = F.array(F.struct(_literal(start).alias("start"), _literal(entries).alias("entries")))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def rank(t: Column, left: Column, right: Column) -> Column:
        entry = F.get(t["entries"], F.get(t["start"], left) + right)
        return let(entry, lambda e: F.when(F.shiftrightunsigned(e, _RANK_BITS) == left, e.bitwiseAND(_NO_RANK - 1)).otherwise(F.lit(_NO_RANK)))

    def merged(t: Column, s: Column, r: Column, least: Column, p: Column) -> Column:
        """The state after replacing the pair at 1-based place p."""
        n = F.size(s)
        before = F.when(p > 1, F.array(rank(t, F.get(s, p - 2), least))).otherwise(F.expr("cast(array() as array<int>)"))
        after = F.when(p + 1 < n, F.array(rank(t, least, F.get(s, p + 1)))).otherwise(F.expr("cast(array() as array<int>)"))
        new_s = F.concat(F.slice(s, F.lit(1), p - 1), F.array(least), F.slice(s, p + 2, n))
        new_r = F.concat(F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(r, p + 2, n))
        return F.struct(new_s.alias("s"), new_r.alias("r"))

    def step(t: Column, state: Column) -> Column:
        return let(
            F.array_min(state["r"]),
            lambda least: F.when(least.isNull() | (least >= _NO_RANK), state).otherwise(
                let(F.array_position(state["r"], least).cast("int"), lambda p: merged(t, state["s"], state["r"], least, p))
            ),
        )

    def folded(t: Column) -> Column:
        first = F.transform(F.slice(symbols, F.lit(1), F.size(symbols) - 1), lambda x, i: rank(t, x, F.get(symbols, i + 1)))
        start = F.struct(symbols.alias("s"), first.alias("r"))
        return F.aggregate(F.slice(symbols, F.lit(1), F.size(symbols) - 1), start, lambda state, _: step(t, state))["s"]

    return F.when(F.size(symbols) < 2, symbols).otherwise(let_table(table, folded))


def let_table(table: Column, body) -> Column:
    return F.get(F.transform(table, body), F.lit(0))


class Splitter:
    """Units of texts (a word with its space, mostly) and the pattern's matches in a unit."""

    def __init__(self, pattern: str, path: str):
        self.pattern, self.ranks = regex.compile(pattern), read_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pieces: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            pieces[rank] = word
        #: By id: the id as text after a space, and the bytes it decodes to.
        self.told = pa.array([b" %d" % i for i in range(len(pieces))], pa.large_binary())
        self.pieces = pa.array(pieces, pa.large_binary())

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or text[-1] == " " or _IN_A_RUN.search(text):
            return self.pattern.findall(text)
        parts = text.replace(" ", "\0 ").split("\0")
        return parts if parts[0] else parts[1:]

    def words(self, unit: str) -> list[str]:
        """The pattern's matches; letters after one space or none are one match."""
        return [unit] if (unit[1:] if unit[0] == " " else unit).isalpha() else self.pattern.findall(unit)

    def cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts one after another, and each text's count of them."""
        blob, at = text_bytes(column)
        spaces = np.flatnonzero(blob == 0x20)
        opens = np.zeros(len(blob) + 1, bool)
        opens[spaces] = True
        opens[at] = True
        # a space before white space or a text's end may be in a run: such texts are looked at one by one
        doubtful = spaces[opens[spaces + 1] | _WHITE[blob[np.minimum(spaces + 1, len(blob) - 1)]]]
        for i in np.unique(np.searchsorted(at, doubtful, "right") - 1).tolist():
            text = column[i].as_py()
            if text[-1] != " " and not _IN_A_RUN.search(text):
                continue
            ends = np.cumsum([len(u.encode()) for u in self.pattern.findall(text)], dtype=np.int64) + at[i]
            if not len(ends) or ends[-1] != at[i + 1]:  # the pattern leaves something out
                units = [self.units(t) for t in column.to_pylist()]
                return pa.array(chain.from_iterable(units), pa.large_string()), np.array([len(u) for u in units], np.int32)
            opens[at[i] + 1 : at[i + 1]] = False
            opens[ends] = True
        opens[len(blob)] = True
        starts = np.flatnonzero(opens)
        units = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(blob))
        return units, np.diff(np.searchsorted(starts, at)).astype(np.int32)

    def symbols(self, words: pa.Array) -> pa.ListArray:
        """The byte symbols of each word."""
        blob, at = text_bytes(words)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(self.byte[blob]))


@lru_cache(2)
def splitter(pattern: str, path: str) -> Splitter:
    return Splitter(pattern, path)


@lru_cache(2)
def _ragged(path: str) -> PairTable:
    left, right, rank = pairs_of(path).T
    return PairTable(left, right, rank, rank)


def long_word_ids(word: bytes, path: str, pattern: str) -> list[int]:
    symbols = splitter(pattern, path).byte[np.frombuffer(word, np.uint8)]
    return merge_all(symbols, np.array([len(symbols)]), _ragged(path))[0].tolist()


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit integers, each as compressed planes of its bytes."""
    out = []
    for values in arrays:
        planes = np.ascontiguousarray(np.asarray(values, np.int32).view(np.uint8).reshape(-1, 4).T)
        data = pa.compress(planes, "zstd", asbytes=True)
        out += [len(values).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = (int.from_bytes(data[at + i : at + i + 8], "little") for i in (0, 8))
        planes = np.frombuffer(pa.decompress(data[at + 16 : at + 16 + size], 4 * n, "zstd"), np.uint8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.int32))
        at += 16 + size
    return out


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _ragged_places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after another."""
    ends = _ends(size)
    return np.repeat(start - ends[:-1], size) + np.arange(ends[-1])


class Slice:
    """Texts as numbers of distinct units; a unit is a list of ids (-1 - id) and of places among the words to be folded."""

    def __init__(self, ranks_path: str, pattern: str):
        self.path, self.pattern, self.own = ranks_path, pattern, splitter(pattern, ranks_path)
        self.size, self.ids, self.counts, self.codes = 0, [], [], []
        self.units: dict[str, int] = {}
        self.place: dict[str, int] = {}
        self.words: list[str] = []
        self.sizes, self.elements = array("i"), array("i")

    def add(self, part: pa.RecordBatch) -> None:
        units, counts = self.own.cut(part.column(1))
        coded = units.dictionary_encode()
        mine, numbers = coded.dictionary.to_pylist(), self.units
        known = len(numbers)
        number = np.array([numbers.setdefault(u, len(numbers)) for u in mine], np.int32)
        for u, n in zip(mine, number.tolist(), strict=True):
            if n >= known:
                before = len(self.elements)
                for word in self.own.words(u):
                    self._tell(word)
                self.sizes.append(len(self.elements) - before)
        self.ids.append(part.column(0))
        self.counts.append(counts)
        self.codes.append(number[coded.indices.to_numpy()] if len(mine) else number)
        self.size += part.column(1).nbytes

    def _tell(self, word: str) -> None:
        found = self.place.get(word)
        if found is None:
            data = word.encode()
            rank = self.own.ranks.get(data)
            if rank is None and len(data) > FOLD_BYTES:
                self.elements.extend(-1 - i for i in long_word_ids(data, self.path, self.pattern))
                return
            if rank is None:
                found = len(self.words)
                self.words.append(word)
            else:
                found = -1 - rank
            self.place[word] = found
        self.elements.append(found)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The slice as two rows: its texts' unit numbers, and its words.

        Units are numbered as they first come, so a first one needs no number; others are told by how common they are.
        """
        codes, sizes, elements = np.concatenate(self.codes), np.array(self.sizes, np.int32), np.array(self.elements, np.int32)
        fresh = np.diff(np.maximum.accumulate(codes), prepend=-1) > 0
        if fresh.sum() != len(sizes):
            raise ValueError("units are not numbered as they first come")
        times = np.bincount(codes, minlength=len(sizes))
        order = np.argsort(-times, kind="stable")[: int((times > 1).sum())]
        rank = np.empty(len(sizes), np.int32)
        rank[order] = np.arange(len(order))
        again = rank[codes[~fresh]]
        low = np.full(len(codes), _FIRST)
        low[~fresh] = np.minimum(again, _RARE)
        direct = elements < 0
        numbers = _packed(np.concatenate(self.counts), low, again[again >= _RARE] - _RARE, np.diff(order, prepend=0), sizes, direct, elements[direct], np.diff(elements[~direct], prepend=0))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(self.ids), pa.array(self.words, pa.string()))]
        for ids, data, words, of in ((lists[0], pa.array([numbers], pa.binary()), pa.nulls(1, lists[1].type), "texts"), (pa.nulls(1, lists[0].type), pa.nulls(1, pa.binary()), lists[1], "words")):
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, data, words, pa.array([of])], ["slice", "doc_ids", "numbers", "words", "of"])


def _blocks(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The held words' ids, a block for each slice: places, sizes, ids."""
    slice_, place, size = (np.concatenate([x[i] for x in held]) for i in range(3))
    start = np.concatenate([x[3] + base for x, base in zip(held, _ends(np.array([len(x[4]) for x in held])), strict=False)])
    ids = np.concatenate([x[4] for x in held])
    order = np.lexsort((place, slice_))
    slice_, place, size, start = slice_[order], place[order], size[order], start[order]
    ids, ends = ids[_ragged_places(start, size)], _ends(size)
    first = np.flatnonzero(np.concatenate([[True], slice_[1:] != slice_[:-1]]))
    cells = [_packed(np.diff(place[a:b], prepend=0), size[a:b], ids[ends[a] : ends[b]]) for a, b in zip(first.tolist(), np.append(first[1:], len(slice_)).tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(slice_[first]), pa.array(cells, pa.binary())], ["slice", "block"])


def _digests(texts: pa.Table, blocks: pa.Table, own: Splitter) -> pa.Table:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a slice's texts from its words' ids."""
    counts, low, rare, order, sizes, direct, given, refs = _unpacked(texts["numbers"][0].as_py())
    codes, fresh = np.empty(len(low), np.int32), low == _FIRST
    codes[fresh], again = np.arange(len(sizes)), low[~fresh]
    again[again == _RARE] += rare
    codes[~fresh] = np.cumsum(order)[again]
    direct = direct.astype(bool)
    elements = np.empty(len(direct), np.int64)
    elements[direct], elements[~direct] = given, np.cumsum(refs)
    doc_ids = texts["doc_ids"].combine_chunks().flatten()
    none = np.zeros(0, np.int64)
    parts = [_unpacked(cell) for cell in blocks["block"].to_pylist()]
    at, size, ids = (np.concatenate([none, *x]) for x in ([np.cumsum(p[0]) for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
    # words by place, then units as runs of ids
    n_words = int(elements.max(initial=-1)) + 1
    start_of, size_of = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    start_of[at], size_of[at] = _ends(size)[:-1], size
    if not size_of.all():
        raise ValueError("a slice lacks the ids of a word")
    start, length = np.zeros(len(elements), np.int64), np.ones(len(elements), np.int64)
    start[direct], start[~direct], length[~direct] = len(ids) + np.arange(direct.sum()), start_of[elements[~direct]], size_of[elements[~direct]]
    ids = np.concatenate([ids, -1 - elements[direct]])[_ragged_places(start, length)]
    bounds = _ends(length)[_ends(sizes)]
    named, pieces = own.told.take(pa.array(ids)), own.pieces.take(pa.array(ids))
    n_ids = np.diff(bounds)
    laid = []
    for x in (named, pieces):
        offsets = np.frombuffer(x.buffers()[1], np.int64, len(x) + 1)[bounds]
        laid.append(pa.Array.from_buffers(pa.large_binary(), len(n_ids), [None, pa.py_buffer(offsets), x.buffers()[2]]))
    ends, n_tokens, hashes = _ends(counts), np.zeros(len(counts), np.int64), ([], [])
    row = 0
    while row < len(counts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + UNITS, "right")) - 1)
        mine, edge = codes[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        n_tokens[row:stop] = np.diff(_ends(n_ids[mine])[edge])
        for x, skip, out in zip(laid, (1, 0), hashes, strict=True):
            got = x.take(pa.array(mine))
            offsets, data = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[edge].tolist(), memoryview(got.buffers()[2] or b"")
            out += [hashlib.sha256(data[a + skip : b] if b > a else b"").hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        row = stop
    return pa.table([doc_ids, pa.array(n_tokens), pa.array(hashes[0], pa.string()), pa.array(hashes[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def folded_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """ids, slices and places of the words of all slices: one row a word, or one in each Arrow batch that has it."""

    def spelled(batches) -> Iterator[pa.RecordBatch]:
        """Each word once, with the slices and places it is wanted at."""
        own = splitter(pattern, ranks_path)
        for b in batches:
            word = b.column(2)
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]))
            bounds = pa.array(np.append(first, len(word)), pa.int32())
            yield pa.RecordBatch.from_arrays([own.symbols(word.take(pa.array(first))), *(pa.ListArray.from_arrays(bounds, b.column(i)) for i in range(2))], ["symbols", "slices", "places"])

    wanted = words.select("slice", F.posexplode("words").alias("place", "word")).repartition("word").sortWithinPartitions("word")
    return wanted.mapInArrow(spelled, "symbols array<int>, slices array<long>, places array<int>").select(fold_merges(F.col("symbols"), ranks_path).alias("ids"), "slices", "places")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    work = Workspace(docs.sparkSession, "bpe")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def sliced(batches) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, Slice(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if now.ids and now.size + part.column(1).nbytes > SLICE:
                    yield from now.rows(number)
                    number, now = number + 1, Slice(ranks_path, pattern)
                now.add(part)
        if now.ids:
            yield from now.rows(number)

    coded = work.written(texts.mapInArrow(sliced, f"slice long, doc_ids array<{kind}>, numbers binary, words array<string>, of string"), "coded", "zstd", "of")
    words = coded.filter("of = 'words'")

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids, slices_, places = (b.column(i) for i in range(3))
            times = np.diff(slices_.offsets.to_numpy())
            at = ids.offsets.to_numpy().astype(np.int64)
            held.append((slices_.flatten().to_numpy(), places.flatten().to_numpy(), np.repeat(np.diff(at), times), np.repeat(at[:-1] - at[0], times), ids.flatten().to_numpy()))
            n += len(held[-1][0])
            if n >= PLACES:
                yield from _blocks(held)
                held, n = [], 0
        if n:
            yield from _blocks(held)

    blocks = work.written(folded_words(words, ranks_path, pattern).mapInArrow(dealt, "slice long, block binary"), "blocks", "zstd")
    work.drop_part(coded, "of=words")

    def digests(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        return _digests(texts, blocks, splitter(pattern, ranks_path))

    return coded.filter("of = 'texts'").select("slice", "doc_ids", "numbers").groupBy("slice").cogroup(blocks.groupBy("slice")).applyInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
