"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces (documents with their end token, cut only where longer than a sequence) are
dealt at random into groups of a fixed expected size; each group is packed alone:
a bin is filled greedily with the largest pieces that fit, then its smallest piece
gives way to two unpacked ones whose sum fits the widened gap more tightly. Bins
with a gap are opened again and packed in later, fewer groups, until one group holds
what is left. Only where a round leaves more than a share of LEFT of its pieces (many of over
half a sequence) is the next one the last, and packs groups apart with slightly more sequences.

Defined results: a null or empty text is a piece of one token. Every row is packed,
repeated ones and ones with a null id too. Texts are tokenised whole. Ties go to
the piece dealt first. Other columns, whatever their names, are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace
from clearprose.llm.words import slices, text_bytes, words_of

LENGTH = 4096
END_ID = 1
#: Expected pieces of a group.
GROUP_PIECES = 1024
#: A round of packing that leaves more than this share of its pieces is the last; all others open the bins with a gap again.
LEFT = 0.5
#: Distinct words whose ids a worker remembers (about 50 bytes each), and the newest that are kept apart between merges.
REMEMBERED, FRESH = 1_500_000, 1 << 16


class WordEncoder:
    """Ids of texts, word by word, for a vocabulary that drops white space and lower-cases ASCII.

    Words are known by their 64-bit hashes; only words not met before become strings
    and go to the tokenizer, those of a slice in one text with a special token between
    them. A full stop or comma after an ASCII letter is a word of its own.
    """

    MARK = "<|startoftext|>"
    STOPS = b".,"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.mark = self.own.token_to_id(self.MARK)
        self.stop_id = np.zeros(256, np.uint32)
        for c in self.STOPS:
            (self.stop_id[c],) = self._one(chr(c))
        self.clear()

    def clear(self) -> None:
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2  # sorted word hashes and their numbers: most, and the newest
        self.count = 0
        self.flat, self.offset, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def _several(self, words: list[str]) -> list[np.ndarray]:
        ids = self._one(self.MARK.join(words))
        cuts = np.flatnonzero(ids == self.mark)
        return [ids[s:e] for s, e in zip(np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist(), strict=True)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each word's number; -1 for words not met yet."""
        out = np.full(len(keys), -1, np.int64)
        for held, numbers in self.known:
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[at] == keys
                out[hit] = numbers[at[hit]]
        return out

    def _merged(self, some: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(some, more, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        odd = {i for i, w in enumerate(words) if "<|" in w}
        coded: dict[int, np.ndarray] = {i: self._one(words[i]) for i in odd}
        plain = [i for i in range(len(words)) if i not in odd]
        for k in range(0, len(plain), 256):
            coded.update(zip(plain[k : k + 256], self._several([words[i] for i in plain[k : k + 256]]), strict=True))
        sizes = np.array([len(coded[i]) for i in range(len(words))], np.int64)
        n, total = self.count, int(sizes.sum())
        while n + len(keys) > len(self.size):
            self.offset, self.size = np.append(self.offset, np.zeros_like(self.offset)), np.append(self.size, np.zeros_like(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + total] = np.concatenate([coded[i] for i in range(len(words))])
        self.offset[n : n + len(keys)] = self.used + np.append(0, np.cumsum(sizes)[:-1])
        self.size[n : n + len(keys)] = sizes
        self.used += total
        self.count += len(keys)
        most, fresh = self.known
        fresh = self._merged(fresh, (keys, np.arange(n, n + len(keys), dtype=np.int32)))
        self.known = [most, fresh]
        if len(fresh[0]) > FRESH:
            self.known = [self._merged(most, fresh), (fresh[0][:0], fresh[1][:0])]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the end id."""
        blob, origins = text_bytes(column)
        w = words_of(blob, origins, self.STOPS)
        keys, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
        if self.count > REMEMBERED:
            self.clear()
        number = self.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)
            number[new] = np.arange(self.count, self.count + len(new))
            self.learn(keys[new], [blob[s:e].tobytes().decode() for s, e in spans])
        known = number[where]
        stop = w.stops > 0
        sizes = self.size[known] + stop
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[known] - (ends - sizes), sizes)
        ids = self.flat[np.minimum(at, len(self.flat) - 1)]
        ids[ends[stop] - 1] = self.stop_id[w.stops[stop]]
        cuts = np.append(0, ends)[w.bounds].tolist()
        end = np.array([END_ID], "<u4").tobytes()
        return [ids[s:e].astype("<u4").tobytes() + end for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(docs: DataFrame, path: str, doc_id: str, text: str, length: int) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, uid = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = defaultdict(list)
                for i, ids in enumerate(own.encode(part.column(1))):
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        piece = ids[at : at + 4 * length]
                        for name, value in (("row", i), ("piece", k), ("start", at // 4), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("uid", uid)):
                            rows[name].append(value)
                        uid += 1
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                ids = part.column(0).take(pa.array(rows["row"], pa.int64()))
                whole = [pa.array(rows["uid"], pa.int64()), ids, pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in names[3:])]
                yield pa.RecordBatch.from_arrays(whole, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Pool:
    """Unpacked pieces by length; a big integer has a bit for each length that is there, another the same bits mirrored."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.bits, self.mirror = capacity, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in range(len(lengths) - 1, -1, -1):
            self.put(lengths[i], i)

    def put(self, length: int, item: int) -> None:
        if not self.stacks[length]:
            self.bits |= 1 << length
            self.mirror |= 1 << (self.capacity - length)
        self.stacks[length].append(item)

    def take(self, length: int) -> int:
        item = self.stacks[length].pop()
        if not self.stacks[length]:
            self.bits &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))
        return item

    def largest(self, most: int) -> int:
        """The largest length there of at most ``most``; 0 for none."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1)

    def pair(self, total: int) -> int:
        """A length x there with another of total - x there; 0 for none."""
        shift = self.capacity - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        while both:
            x = both.bit_length() - 1
            if 2 * x != total or len(self.stacks[x]) > 1:
                return x
            both &= ~(1 << x)
        return 0


def best_two_fit(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers; every length is from 1 to ``capacity``."""
    pool, bins = Pool(lengths, capacity), []
    while pool.bits:
        packed, gap = [], capacity
        while gap and (length := pool.largest(gap)):
            packed.append(pool.take(length))
            gap -= length
        if gap and len(packed) > 1:
            smallest = lengths[packed[-1]]
            for total in range(smallest + gap, smallest, -1):
                if x := pool.pair(total):
                    pool_items = [pool.take(x), pool.take(total - x)]
                    pool.put(smallest, packed.pop())
                    packed += pool_items
                    break
        bins.append(packed)
    return bins


def _packer(length: int, round_: int, least: int):
    """Packs one group; bins of less than ``least`` tokens get no sequence and are opened again."""

    def packed_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes, group = table["length"].to_pylist(), table["grp"][0].as_py()
        item, sequence, offset = [], [], []
        for number, packed in enumerate(best_two_fit(sizes, length)):
            whole = sum(sizes[i] for i in packed) >= least
            at = 0
            for i in packed:
                item.append(i)
                sequence.append((round_ << 58) + (group << 28) + number if whole else None)
                offset.append(at)
                at += sizes[i]
        order = pa.array(item, pa.int64())
        return pa.table({"uid": table["uid"].take(order), "length": table["length"].take(order), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return packed_group


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Each piece with its sequence_id and offset there."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.written(pieces_of(docs, tokenizer_path, doc_id, text, length), "pieces")
    count = pieces.count()
    left = pieces.select("uid", "length")
    placed = []
    earlier, round_ = math.inf, 0
    while count:
        groups = max(1, -(-count // GROUP_PIECES))
        last = groups == 1 or count > LEFT * earlier
        grouped = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups))).groupBy("grp")
        done = work.written(grouped.applyInArrow(_packer(length, round_, 0 if last else length), "uid long, length long, sequence_id long, offset long"), f"round{round_}")
        placed.append(done.filter(F.col("sequence_id").isNotNull()).select("uid", "sequence_id", "offset"))
        if last:
            break
        left = done.filter(F.col("sequence_id").isNull()).select("uid", "length")
        earlier, count, round_ = count, left.count(), round_ + 1
    every = pieces.select("uid", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).limit(0)
    for more in placed:
        every = every.unionByName(more)
    return pieces.join(every, "uid").drop("uid")
