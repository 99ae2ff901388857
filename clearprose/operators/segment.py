"""Sentences and paragraphs of documents, told inside each document's row.

One Arrow function takes the prose lines of a batch of documents as bytes and offsets.
Blocks, fragments and the state that goes from line to line are running sums and
searches over all lines of the batch at once, so no text leaves its row, and no line or
document is a step of a Python loop. Columns are bytes, from 1. A sentence over
several lines is placed at its last open fragment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose.config import PROSE_KINDS
from clearprose.session import ready

SENTENCE = "sent_no:int,line:bigint,col:bigint,word_count:int,para_no:int,text:string"
PARAGRAPH = "para_no:int,line:bigint,n_sentences:int"
SEGMENTS = f"struct<sentences:array<struct<{SENTENCE}>>,paragraphs:array<struct<{PARAGRAPH}>>>"
#: A number of words that no sentence has: no texts are wanted.
NO_TEXTS = 1 << 30
#: Bytes of text of the documents that are handled together; a longer document is handled alone.
SLICE_BYTES = 1 << 20

# Characters that end a sentence, and those that may follow such an end.
TERMINATORS, CLOSERS = ".!?。！？", "\"”»›)]}"


@dataclass
class Lines:
    """Lines of some documents, one after another, as bytes."""

    data: np.ndarray  # with three zero bytes after the last line
    at: np.ndarray  # byte offset of each line, and the end
    doc: np.ndarray  # document of each line
    no: np.ndarray  # number of each line in its document, from 1
    space: np.ndarray  # bytes of white space
    solid: np.ndarray  # places of the other bytes, and the end

    @property
    def low(self) -> np.ndarray:
        return self.at[:-1]

    @property
    def high(self) -> np.ndarray:
        return self.at[1:]

    def line_of(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, p, "right") - 1

    def next_solid(self, p: np.ndarray) -> np.ndarray:
        return self.solid[np.searchsorted(self.solid[:-1], p)]

    def n_solid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.solid[:-1], b) - np.searchsorted(self.solid[:-1], a)


def space_bytes(b: np.ndarray) -> np.ndarray:
    """Bytes of characters that are white space in Unicode; ``b`` ends with three zero bytes."""
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    wide = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    if len(wide):
        x, y, z = b[wide], b[wide + 1], b[wide + 2]
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        three = (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        three |= ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        space[wide[two | three]] = space[wide[two | three] + 1] = True
        space[wide[three] + 2] = True
    return space


def solid_places(space: np.ndarray) -> np.ndarray:
    """Places of bytes that aren't white space, and the end: the first of the three zero bytes."""
    return np.flatnonzero(~space[:-2])


def lines_in(prose: pa.ListArray) -> Lines:
    """The lines of an array of lists of lines; null lists have none, null lines are empty."""
    bounds = prose.offsets.to_numpy().astype(np.int64)
    flat = prose.values.slice(bounds[0], bounds[-1] - bounds[0]).cast(pa.large_string())
    if flat.null_count:
        flat = flat.fill_null("")
    _, offsets, raw = flat.buffers()
    at = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
    data = np.zeros(at[-1] - at[0] + 3, np.uint8)
    if len(data) > 3:
        data[:-3] = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    space = space_bytes(data)
    return Lines(data, at - at[0], doc, np.arange(len(doc)) - (bounds[:-1] - bounds[0])[doc] + 1, space, solid_places(space))


def counted(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places from a to b ``mask`` holds for."""
    on = np.flatnonzero(mask)
    return np.searchsorted(on, b) - np.searchsorted(on, a)


def _run_ends(mask: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The first place from p on where mask doesn't hold, ``most`` at the latest."""
    on = np.flatnonzero(mask)
    if not len(on):
        return np.minimum(p, most)
    last = on[np.append(np.flatnonzero(np.diff(on) > 1), len(on) - 1)]  # of each run
    run = np.minimum(np.searchsorted(last, p), len(last) - 1)
    return np.minimum(np.where(mask[p], last[run] + 1, p), most)


def blocks(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Each line's block (B blank, T thematic break, S heading, I item, N other) and the place where its content begins."""
    d, low, high = x.data, x.low, x.high
    begin = x.next_solid(low)
    blank = begin >= high
    shallow = ~blank & (begin - low <= 3)
    first = d[begin]
    gap = lambda p: (p < high) & ((d[p] == 0x20) | (d[p] == 0x09))
    block, content = np.full(len(low), "N"), low.copy()
    block[blank] = "B"
    thematic = np.zeros(len(low), bool)
    for c in b"-_*=":
        lines = np.flatnonzero(shallow & (first == c))
        solid = x.n_solid(low[lines], high[lines])
        thematic[lines] = (counted(d == c, low[lines], high[lines]) == solid) & (solid >= 3)
    block[thematic] = "T"
    some = shallow & ~thematic

    quote = some & (first == ord(">"))
    end = _run_ends(d == ord(">"), begin, high)
    content = np.where(quote, end + gap(end), content)

    end = _run_ends(d == ord("#"), begin, high)
    heading = some & (first == ord("#")) & (end - begin <= 6) & ((end == high) | gap(end))
    content = np.where(heading, end + gap(end), content)
    block[heading] = "S"

    bullet = some & np.isin(first, list(b"-*+")) & gap(begin + 1)
    content = np.where(bullet, begin + 2, content)
    end = _run_ends((d >= 48) & (d <= 57), begin, high)
    number = some & (first >= 48) & (first <= 57) & (end - begin <= 9) & (end < high) & ((d[end] == ord(".")) | (d[end] == ord(")"))) & ((end + 1 == high) | gap(end + 1))
    content = np.where(number, end + 1 + gap(end + 1), content)
    block[bullet | number] = "I"
    return block, content


def _marks(d: np.ndarray, characters: str) -> np.ndarray:
    """Bytes of these characters."""
    out = np.zeros(len(d), bool)
    for raw in (c.encode() for c in characters):
        here = d == raw[0]
        if len(raw) > 1:
            p = np.flatnonzero(here[: len(d) - len(raw) + 1])
            for k in range(1, len(raw)):
                p = p[d[p + k] == raw[k]]
            here = np.zeros(len(d), bool)
            for k in range(len(raw)):
                here[p + k] = True
        out |= here
    return out


def cuts(x: Lines, content: np.ndarray, prose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sentence ends, after its terminators and closers, and their lines; only ``prose`` lines have any."""
    d, n = x.data, len(x.data) - 3
    p = np.flatnonzero(_marks(d, TERMINATORS)[:n])
    line = x.line_of(p)
    mine = prose[line] & (p >= content[line])
    p, line = p[mine], line[mine]
    # a dot after a digit, or between word characters, ends nothing; nor does the ! of a shebang and what follows it
    word = (d >= 48) & (d <= 57) | (d >= 65) & (d <= 90) | (d >= 97) & (d <= 122) | (d == 95)
    inner = p > content[line]
    before, after = d[np.maximum(p - 1, 0)], (p + 1 < x.high[line]) & word[p + 1]
    digit = (before >= 48) & (before <= 57)
    guarded = (d[p] == ord(".")) & inner & (digit | (word[np.maximum(p - 1, 0)] & after))
    ending = np.zeros(n + 1, bool)
    ending[p[~guarded]] = True
    shebang = np.flatnonzero(prose & (content + 1 < x.high) & (d[np.minimum(content, n)] == ord("#")) & (d[np.minimum(content + 1, n)] == ord("!")))
    for k, end in zip((content[shebang] + 1).tolist(), _run_ends(ending, content[shebang] + 1, x.high[shebang]).tolist(), strict=True):
        ending[k:end] = False
    closing = _marks(d, CLOSERS)[: n + 1]
    some = ending | closing
    if not ending.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # closers count where a terminator stands before them in their run
    p = np.flatnonzero(some)
    line, nth = x.line_of(p), np.arange(len(p))
    starts = (np.diff(p, prepend=-2) > 1) | (p == x.low[line])
    held = np.maximum.accumulate(np.where(ending[p], nth, -1)) >= np.maximum.accumulate(np.where(starts, nth, 0))
    last, line = p[held], line[held]
    at_end = last + 1 == x.high[line]
    goes = at_end | ~some[last + 1] | (closing[last] & ending[last + 1])
    return last[goes] + 1, line[goes]


@dataclass
class Fragments:
    """Pieces of lines that aren't blank, in order."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    ended: np.ndarray  # by a terminator
    words: np.ndarray


def fragments(x: Lines, content: np.ndarray, prose: np.ndarray) -> Fragments:
    place, of = cuts(x, content, prose)
    start, line = np.concatenate([content[prose], place]), np.concatenate([np.flatnonzero(prose), of])
    order = np.lexsort((start, line))
    start, line = start[order], line[order]
    more = np.append(line[1:] == line[:-1], False)
    end = np.where(more, np.append(start[1:], 0), x.high[line])
    some = x.next_solid(start) < end
    start, end, line, more = start[some], end[some], line[some], more[some]
    opens = ~x.space[:-3]
    opens[1:] &= x.space[:-4]
    opens[x.low[np.diff(x.at) > 0]] = ~x.space[x.low[np.diff(x.at) > 0]]
    words = counted(opens, start, end) + (~x.space[start] & ~opens[np.minimum(start, len(opens) - 1)] if len(opens) else 0)
    return Fragments(start, end, line, more, words)


def _lent(x: Lines, block: np.ndarray, hollow: np.ndarray, left_open: np.ndarray) -> np.ndarray:
    """For each line the first line of the run of hollow ones (markers without content) before it that lends its place, or -1."""
    n = len(block)
    lends = np.flatnonzero(hollow & (~left_open | (block == "S") | (block == "I")))
    fresh = np.searchsorted(x.doc, x.doc)  # a document's first line
    solid = np.maximum.accumulate(np.where(~hollow, np.arange(n), -1))
    before = np.maximum(np.concatenate([[-1], solid[:-1]]), fresh - 1) if n else solid
    found = np.append(lends, n)[np.searchsorted(lends, before + 1)]
    return np.where(~hollow & (found < np.arange(n)), found, -1)


def _last_before(x: Lines, keep: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of the last line before each that ``keep`` holds for, in its document; False where there is none."""
    at = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), -1))
    before = np.concatenate([[-1], at[:-1]])
    mine = (before >= 0) & (x.doc[before] == x.doc)
    return mine & value[before]


def segmented(prose: pa.ListArray, merge: np.ndarray, texts_over: int = -1, x: Lines | None = None) -> tuple[pa.ListArray, pa.ListArray]:
    """The sentences and the paragraphs of each list of lines (``x``, where they are at hand); lines of a document run on where ``merge`` holds.

    A sentence has its text where it has more than ``texts_over`` words.
    """
    x, n_docs = x or lines_in(prose), len(prose)
    n = len(x.low)
    if not n:
        none = np.zeros(0, np.int64)
        return _lists(none, n_docs, SENTENCE, [none] * 5 + [[]]), _lists(none, n_docs, PARAGRAPH, [none] * 3)
    block, content = blocks(x)
    solid_kind = (block != "B") & (block != "T")
    f = fragments(x, content, solid_kind)
    merged = merge[x.doc]

    has = np.zeros(n, bool)
    has[f.line] = True
    last = np.zeros(n, bool)  # whether the line's last fragment is open
    last[f.line] = ~f.ended  # later fragments of a line overwrite earlier ones
    hollow = solid_kind & ~has
    open_end = has & last & merged & ((block == "N") | (block == "I"))
    lent = _lent(x, block, hollow, _last_before(x, ~hollow, open_end))

    # paragraphs of lines
    first_line = x.no == 1
    opens = np.concatenate([[False], block[:-1] == "B"]) | (block == "T") | (block == "S") | (block == "I")
    opens &= ~first_line
    para = np.cumsum(opens | first_line) - 1  # over all documents
    para_line = np.flatnonzero(opens | first_line)

    # sentences of fragments
    m = len(f.line)
    breaks = np.cumsum(block != "N")
    same_doc = np.concatenate([[False], x.doc[f.line[1:]] == x.doc[f.line[:-1]]]) if m else np.zeros(0, bool)
    back = np.maximum(np.arange(m) - 1, 0)
    fresh = ~same_doc | (f.line[back] != f.line)
    starts = ~same_doc | f.ended[back] | (fresh & ((breaks[f.line[back]] != breaks[f.line]) | (block[f.line[back]] == "S") | ~merged[f.line]))
    begin = x.next_solid(f.start)
    col = f.start - x.low[f.line] + 1 + np.where(fresh | ~f.ended, begin - f.start, 0)
    line = f.line.copy()
    lends = f.ended & fresh & (lent[f.line] >= 0)
    line[lends] = lent[f.line[lends]]
    col[lends] = x.high[line[lends]] - x.low[line[lends]] + 1

    s = np.flatnonzero(starts)
    e = np.append(s[1:], m)[: len(s)]
    told = np.maximum(np.where(f.ended[e - 1], e - 2, e - 1), s)  # the last open fragment, or the only one
    words = np.add.reduceat(f.words, s) if len(s) else np.zeros(0, np.int64)
    doc, at = x.doc[line[told]], line[told]
    texts = [None] * len(s)
    told_in_words = np.flatnonzero(words > texts_over)
    if len(told_in_words):
        # the fragments' ends without white space
        raw, first, stop = x.data.tobytes(), begin.tolist(), (x.solid[np.searchsorted(x.solid, f.end) - 1] + 1).tolist()
        for k, a, b in zip(told_in_words.tolist(), s[told_in_words].tolist(), e[told_in_words].tolist(), strict=True):
            texts[k] = b" ".join(raw[first[i] : stop[i]] for i in range(a, b)).decode()

    # numbers count in each document
    origin = para[np.searchsorted(x.doc, np.arange(n_docs)).clip(max=n - 1)]
    nth = np.arange(len(s)) - np.searchsorted(doc, doc) + 1
    sentences = _lists(doc, n_docs, SENTENCE, [nth, x.no[at], col[told], words, para[at] - origin[doc], texts])
    owned, count = np.unique(para[at], return_counts=True)
    of = x.doc[para_line[owned]]
    return sentences, _lists(of, n_docs, PARAGRAPH, [owned - origin[of], x.no[para_line[owned]], count])


def _lists(owner: np.ndarray, n_docs: int, fields: str, values: list) -> pa.ListArray:
    """Rows of (sorted) documents as a list of structs a document."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    named = [f.split(":") for f in fields.split(",")]
    rows = pa.StructArray.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, named, strict=True)], [n for n, _ in named])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_docs + 1)), pa.int32()), rows)


def slices(lists: pa.ListArray, limit: int = SLICE_BYTES, also: pa.ListArray | None = None) -> list[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text (in ``also`` too), or one longer row."""

    def sums(lists: pa.ListArray) -> np.ndarray:
        flat = lists.values.cast(pa.large_string())
        return np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)[lists.offsets.to_numpy()] if len(flat) else np.zeros(len(lists) + 1, np.int64)

    sizes = sums(lists) + (sums(also) if also is not None else 0)
    out, row = [], 0
    while row < len(lists):
        end = max(row + 1, min(len(lists), int(np.searchsorted(sizes, sizes[row] + limit, "right")) - 1))
        out.append((row, end))
        row = end
    return out or [(0, 0)]


def _segments(texts_over: int):
    def run(prose: pa.Array, merge: pa.Array) -> pa.Array:
        flags = merge.to_numpy(zero_copy_only=False)
        parts = [pa.StructArray.from_arrays(segmented(prose.slice(a, b - a), flags[a:b], texts_over), ["sentences", "paragraphs"]) for a, b in slices(prose)]
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, SEGMENTS)


def with_segments(arrays: DataFrame, texts_over: int = -1) -> DataFrame:
    """``arrays`` (kind, prose and others) with ``segments``: the sentences and paragraphs of each row's prose lines."""
    ready(arrays.sparkSession)
    return arrays.withColumn("segments", _segments(texts_over)(F.col("prose"), merges(F.col("kind"))))


def merges(kind: Column) -> Column:
    """Whether a sentence may run on over lines: in prose; comment lines of a source stay apart."""
    return F.coalesce(kind.isin(*PROSE_KINDS), F.lit(False))


def sentences(arrays: DataFrame, texts_over: int = -1) -> DataFrame:
    """doc_id, kind, sent_no, line, col, word_count, para_no and text (null up to ``texts_over`` words) of each sentence of ``arrays`` (doc_id, kind, prose)."""
    return with_segments(arrays, texts_over).select("doc_id", "kind", F.inline_outer("segments.sentences")).filter("line is not null")


def paragraphs(arrays: DataFrame) -> DataFrame:
    """doc_id, kind, para_no, line and n_sentences of each paragraph that owns a sentence."""
    return with_segments(arrays, NO_TEXTS).select("doc_id", "kind", F.inline_outer("segments.paragraphs")).filter("line is not null")
