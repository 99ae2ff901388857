"""Spelling variants: words one edit apart, by bands of letter-parity bitmasks.

A mask has a bit for each letter, set where the letters hold it an odd number of
times. One inserted or deleted letter flips one bit, a replaced one flips two. A word has two bands, the masks of
its first half and of the rest: an edit lies in one, so the other is equal in any pair one edit apart (halves of a slice of
the alphabet would not do: most letters are absent from most words). Words meet in units of
(band, its bits, length): those of the length and those one longer, whose inserted letter stands between the halves or in the
other band. In a unit, pairs whose other bands differ in
exactly two bits (one bit, where lengths differ) are verified letter by letter; a pair of two
lengths counts in the first band if its first halves are equal. A unit of more than BLOCK words is cut into blocks and each pair of
blocks is a unit of its own, so a frequent band value is spread over tasks; units are packed into
groups of about GROUP rows. A group returns counts and the best near word of a word, never pairs.

Words are runs of letters A-Z, a-z and U+00C0-U+00FF, A-Z in lower case. Defined results: null and empty
texts have no words; a null id counts as empty text in the hash; repeated rows count each;
a word of any length is compared whole; ties of n go to the smaller word in code-point order; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.line_dedup import lower_ascii
from clearprose.llm.tables import Workspace
from clearprose.llm.words import mix, text_bytes

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many hashes of (id, run) loses a letter.
DELETES = 31
BLOCK, BLOCK_BYTES, GROUP = 4096, 4 << 20, 16384
#: Most pairs whose masks are compared at once.
_PAIRS = 1 << 19
#: Bits of each third of a mask that fit one 64-bit word with those of the others, and the rest of its 30 bits.
LOW, HIGH = 21, 9

# Letters as Latin-1 bytes; commoner ones first, dealt to three thirds of a mask in turn.
_LETTERS = b"etaoinshrdlcumwfgypbvkjxqz" + bytes(range(0xC0, 0x100))
_BIT = np.zeros((3, 256), np.uint64)
for _i, _c in enumerate(_LETTERS):
    _BIT[_i % 3, _c] = 1 << (_i // 3)


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as Latin-1 bytes, one after another, and their bounds."""
    raw, at = text_bytes(column)
    lead = raw == 0xC3
    letters = np.where(raw >= 0x80, raw + 0x40, raw).astype(np.uint8)[~lead]
    return letters, at - np.concatenate([[0], np.cumsum(lead)])[at]


def masks(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(3, words) thirds of the masks of parity bits."""
    out = np.zeros((3, len(bounds) - 1), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for b in range(3):
            out[b, some] = np.bitwise_xor.reduceat(_BIT[b][letters], bounds[some])
    return out


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """The words of each row's text, letters deleted where the hash says so."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{max(1, min_chars)},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), run.alias("run")).select("d", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    told = runs.withColumn("h", h).select(F.when(F.col("h") % DELETES == 0, cut).otherwise(F.col("run")).alias("word"))
    return told.filter(F.length("word") >= min_chars)


def packed(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of each mask: the bits of all but the rarest letters, and the others, which fit 32 bits."""
    low = np.uint64((1 << LOW) - 1)
    parts = (m & low, LOW), (m >> np.uint64(LOW), HIGH)
    return tuple(x[0] << np.uint64(2 * n) | x[1] << np.uint64(n) | x[2] for x, n in parts)


def bands(letters: np.ndarray, bounds: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(3, words, 2) masks of each band, and of the other with the letter between them: of words one longer than their units, if ``longer``."""
    first = bounds[:-1] + (np.diff(bounds) - longer).clip(0) // 2
    cuts = np.stack([bounds[:-1], first, np.minimum(first + longer, bounds[1:])], axis=1).ravel()
    m = masks(letters, np.append(cuts, bounds[-1:])).reshape(3, -1, 3)
    return m[:, :, [0, 2]], m[:, :, [2, 0]] ^ m[:, :, [1]]


def units(words: DataFrame) -> DataFrame:
    """word, n, band, bits, home, longer, rest and more: each word in the units where it may meet others.

    The bits are spread by a hash; where two bands have one hash their words meet for nothing.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters, bounds = latin(b.column(0))
            sizes = np.diff(bounds)
            for longer in (False, True):
                own, other = bands(letters, bounds, longer)
                for band in (0, 1):
                    rest, more = packed(own[:, :, band])
                    bits, (rest, more) = mix(rest ^ mix(more)), packed(other[:, :, band])
                    cells = [b.column(0), b.column(1), pa.array(np.full(len(sizes), band, np.int32)), pa.array(bits.view(np.int64)), pa.array((sizes - longer).astype(np.int32)), pa.array(np.full(len(sizes), longer)), pa.array(rest.view(np.int64)), pa.array(more.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cells, ["word", "n", "band", "bits", "home", "longer", "rest", "more"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, band int, bits long, home int, longer boolean, rest long, more int")


def _grid(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group in order of their units, and the units' bounds."""
    keys = [group[c].to_numpy() for c in ("j", "i", "home", "bits", "band")]
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(fresh)
    return order, starts, np.append(starts[1:], len(order))


def _alike(x: np.ndarray, y: np.ndarray, rest: np.ndarray, more: np.ndarray, flips: int, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y whose other bands differ in ``flips`` bits."""
    step = max(1, _PAIRS // max(1, len(y)))
    for at in range(0, len(x), step):
        r, c = np.nonzero(np.bitwise_count(rest[x[at : at + step]][:, None] ^ rest[y][None, :]) <= flips)
        if triangle:
            r, c = r[r + at < c], c[r + at < c]
        p, q = x[r + at], y[c]
        good = np.bitwise_count(rest[p] ^ rest[q]) + np.bitwise_count(more[p] ^ more[q]) == flips
        if good.any():
            yield p[good], q[good]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ at one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of ``long`` are those of ``short`` with one letter more."""
    n = short.shape[1]
    head = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_in(group: pa.Table) -> pa.Table:
    """word, n_near, best_n and best: of each word of a group that has near words there."""
    order, starts, ends = _grid(group)
    group = group.take(pa.array(order)).combine_chunks()
    words, n = group["word"].combine_chunks(), group["n"].to_numpy()
    letters, bounds = latin(words)
    rest, more = group["rest"].to_numpy().view(np.uint64), group["more"].to_numpy().view(np.uint32)
    band, home, longer, block, i, j = (group[c].to_numpy(zero_copy_only=False) for c in ("band", "home", "longer", "block", "i", "j"))
    near = [np.zeros((2, 0), np.int64)]

    def rows_of(x: np.ndarray, size: int) -> np.ndarray:
        return letters[bounds[x][:, None] + np.arange(size)]

    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s < 2:
            continue
        size, here = int(home[s]), np.arange(s, e)
        sides = [here[~longer[s:e] & (block[s:e] == b)] for b in (i[s], j[s])]
        above = [here[longer[s:e] & (block[s:e] == b)] for b in (i[s], j[s])]
        same = i[s] == j[s]
        todo = [(sides[0], sides[1], 2, same), (sides[0], above[1], 1, False)] + ([] if same else [(sides[1], above[0], 1, False)])
        for x, y, flips, triangle in todo:
            if not len(x) or not len(y):
                continue
            for a, b in _alike(x, y, rest, more, flips, triangle):
                step = max(1, (1 << 22) // max(1, size))
                for at in range(0, len(a), step):
                    p, q = a[at : at + step], b[at : at + step]
                    good = one_replaced(rows_of(p, size), rows_of(q, size)) if flips == 2 else one_inserted(rows_of(p, size), rows_of(q, size + 1))
                    if flips == 1:  # the first band tells pairs with equal first halves; a half may also be another in another order
                        good &= (rows_of(p, size // 2) == rows_of(q, size // 2)).all(axis=1) != bool(band[s])
                    near.append(np.stack([p[good], q[good]]))
    a, b = np.concatenate(near, axis=1)
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    # a word is in a group more than once where several of its units are
    codes = words.dictionary_encode()
    names, code = codes.dictionary, codes.indices.to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(np.array([w.encode() for w in names.to_pylist()], dtype=object), kind="stable")] = np.arange(len(names))
    own_code, other_code = code[own], code[other]
    by = np.lexsort((rank[other_code], -n[other], own_code))
    first = np.flatnonzero(np.concatenate([[True], own_code[by][1:] != own_code[by][:-1]])) if len(by) else by
    best = by[first]
    count = np.diff(np.append(first, len(by)))
    return pa.table({"word": names.take(pa.array(own_code[best])), "n_near": pa.array(count.astype(np.int64)), "best_n": pa.array(n[other[best]]), "best": names.take(pa.array(other_code[best]))})


def near_words(words: DataFrame, work: Workspace) -> DataFrame:
    """word, n_near, best_n and best of every word of ``words`` (word, n) with a near word."""
    key = ["band", "bits", "home"]
    placed = work.written(units(words), "units")
    spread = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("rows") * F.col("home") / BLOCK_BYTES)).cast("int")
    large = placed.groupBy(*key).agg(F.count("*").alias("rows")).withColumn("blocks", spread).filter("blocks > 1").select(*key, "blocks")
    large = work.written(large, "large")
    cut = placed.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    pair = lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))
    cut = cut.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).select("word", "n", *key, "longer", "rest", "more", "block", "p.i", "p.j")
    groups = max(1, placed.count() // GROUP)
    cut = cut.withColumn("g", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(groups)).cast("int"))
    found = cut.groupBy("g").applyInArrow(near_in, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word and root (the last form) of every word of ``forms`` (word, form); forms are followed by doubling."""
    ends = work.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = ends.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = work.written(ends.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        ends = step.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least ``min_chars`` letters and ``min_count`` occurrences.

    The form is the near word of largest n, if that is at least ``ratio`` times the word's n.
    """
    work = Workspace(docs.sparkSession, "spelling")
    words = occurrences(docs, doc_id, text, min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    words = work.written(words, "words")
    told = words.join(near_words(words, work), "word", "left")
    stands = F.col("best_n") >= F.col("n") * ratio
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("best")).alias("form"), F.when(stands, F.col("best_n")).alias("form_n"))
    told = work.written(told, "told")
    ends = roots(told.filter("form is not null"), work)
    out = told.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
