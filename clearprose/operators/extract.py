"""Prose lines of documents by kind.

What is no prose in a markdown text turns to spaces, byte for byte, so offsets stay. One
Arrow function finds fences, comments, indents and tables over the bytes of all lines of a
batch at once; only lines that open or close something are steps of a loop. Comments of
sources are taken out of their lines: hash comments in the JVM, slash comments line by line.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose.config import PROSE_KINDS
from clearprose.functions.text import lines_of, strip, strip_start
from clearprose.operators.segment import Lines, _run_ends, counted, lines_in, slices, solid_places, space_bytes
from clearprose.session import ready


def clear_spans(source: bytes) -> bytes:
    """The line with closed code spans turned to spaces."""
    text = bytearray(source)
    runs = [(m.start(), m.end()) for m in re.finditer(rb"`+", source)]
    closers: dict[int, list[int]] = {}  # numbers of the runs of each length that may close
    for i, (start, end) in enumerate(runs):
        if not escaped_at(source, start):
            closers.setdefault(end - start, []).append(i)
    at = k = 0
    while k < len(runs):
        start, end = max(runs[k][0], at), runs[k][1]
        if start >= end:
            k += 1
            continue
        if escaped_at(source, start):
            at = start + 1  # the rest of an escaped run may still open
            continue
        same = closers.get(end - start, [])
        if (i := bisect_right(same, k)) == len(same):
            at = start + 1
            continue
        close = runs[same[i]]
        text[start : close[1]] = b" " * (close[1] - start)
        at = close[1] + 1
    return bytes(text)


def escaped_at(source: bytes, at: int) -> bool:
    return at > 0 and source[at - 1 : at] == b"\\"


def _holding(x: Lines, *found: bytes) -> np.ndarray:
    """Whether each line holds these bytes one after another."""
    p = np.flatnonzero(x.data[:-3] == found[0][0])
    for k, byte in enumerate(found[0][1:], 1):
        p = p[p + k < len(x.data)]
        p = p[x.data[p + k] == byte]
    out = np.zeros(len(x.low), bool)
    line = x.line_of(p)
    out[line[p + len(found[0]) <= x.high[line]]] = True
    return out


def _tables(x: Lines) -> np.ndarray:
    """Lines of tables: a header, its delimiter and the data rows after it."""
    begin = np.minimum(x.next_solid(x.low), x.high)
    row = (begin - x.low <= 3) & _holding(x, b"|")
    fresh = x.no == 1
    above = np.concatenate([[False], row[:-1]]) & ~fresh
    # only a row or the line below one can be a delimiter that counts
    delimiter = _holding(x, b"-") & (row | above)
    sizes = np.diff(x.at)
    mine, lines = np.repeat(delimiter, sizes), np.flatnonzero(delimiter)
    if not len(lines):
        return delimiter
    other, first = ~np.isin(x.data[:-3][mine], list(b"|:- ")), np.cumsum(sizes[lines]) - sizes[lines]
    delimiter[lines] = ~np.logical_or.reduceat(other & ~x.space[:-3][mine], first)
    # white space other than blanks may only stand at the ends
    for i in lines[delimiter[lines] & np.logical_or.reduceat(other, first)]:
        delimiter[i] = bool(re.fullmatch(r"[|: \-]+", x.data[x.low[i] : x.high[i]].tobytes().decode().strip()))
    starts = delimiter & above
    data = row & ~delimiter
    # a run of data rows belongs to a table where a delimiter stands right above it
    breaks = np.maximum.accumulate(np.where(~data | fresh, np.arange(len(data)), 0)) if len(data) else np.zeros(0, int)
    out = starts | (data & ~fresh & starts[breaks] & (breaks < np.arange(len(data))))
    out[np.flatnonzero(starts) - 1] = True
    return out


def _hidden(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are in fences or comments or are indented, and lines that stay as they are."""
    d, begin = x.data, np.minimum(x.next_solid(x.low), x.high)
    indent, first = begin - x.low, d[begin]
    hidden, raw = np.zeros(len(begin) + 1, np.int64), np.zeros(len(begin), bool)
    fence, size = np.zeros(len(begin), bool), np.zeros(len(begin), np.int64)
    for c in b"`~":
        here = (first == c) & (indent <= 3) & (begin < x.high)
        run = _run_ends(d == c, begin, x.high) - begin
        size = np.where(here, run, size)
        fence |= here & (run >= 3)
    told = counted(d == ord("`"), begin + size, x.high) > 0  # a backtick after the run
    bare = np.zeros(len(begin), bool)
    bare[fence] = x.next_solid((begin + size)[fence]) >= x.high[fence]
    opens, closes = _holding(x, b"<!--"), _holding(x, b"-->")
    for i in np.flatnonzero(opens):
        opens[i] = d[begin[i] : begin[i] + 4].tobytes() == b"<!--"
    events = np.flatnonzero(fence | opens | closes)
    ends = np.searchsorted(x.doc, x.doc, "right")
    state, comment, last, doc = None, False, 0, -1
    for i in [*events.tolist(), len(begin)]:
        if state or comment:  # lines since the last event
            upto = i if i < len(begin) and x.doc[i] == doc else int(ends[last])
            hidden[last + 1] += 1
            hidden[upto] -= 1
        if i == len(begin):
            break
        if x.doc[i] != doc:
            state, comment, doc = None, False, x.doc[i]
        last, hide = i, True
        if fence[i]:
            if state:
                if first[i] == state[0] and size[i] >= state[1] and bare[i]:
                    state = None
            elif first[i] == ord("`") and told[i]:
                hide, raw[i] = False, True
            else:
                state = (first[i], size[i])
        elif not state:
            hide = comment or bool(opens[i])
            comment = hide and not closes[i]
        if hide:
            hidden[i] += 1
            hidden[i + 1] -= 1
    covered = np.cumsum(hidden)[:-1] > 0
    return covered | (~raw & (indent >= 4)), raw


def cleared(prose: pa.ListArray, is_prose: np.ndarray) -> pa.ListArray:
    """The lists of lines with what is no prose turned to spaces, where ``is_prose`` holds."""
    x = lines_in(prose)
    mine = is_prose[x.doc] if len(x.doc) else np.zeros(0, bool)
    if not mine.any():
        return prose
    before = x.data.copy()
    hidden, raw = _hidden(x)
    sizes = np.diff(x.at)

    def blank(lines: np.ndarray) -> None:
        if (lines := lines & mine).any():
            x.data[:-3][np.repeat(lines, sizes)] = 0x20

    blank(hidden)
    for i in np.flatnonzero(mine & ~hidden & ~raw & (counted(x.data == ord("`"), x.low, x.high) > 1)).tolist():
        x.data[x.low[i] : x.high[i]] = np.frombuffer(clear_spans(x.data[x.low[i] : x.high[i]].tobytes()), np.uint8)
    if not np.array_equal(before, x.data):
        x.space = space_bytes(x.data)
        x.solid = solid_places(x.space)
    blank(_tables(x))
    if np.array_equal(before, x.data):
        return prose
    return with_bytes(prose, x)


def with_bytes(prose: pa.ListArray, x: Lines) -> pa.ListArray:
    flat = pa.LargeStringArray.from_buffers(len(x.low), pa.py_buffer(np.ascontiguousarray(x.at, np.int64)), pa.py_buffer(x.data[:-3].tobytes()))
    bounds = prose.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), flat.cast(pa.string()))


def without_quotes(prose: pa.ListArray) -> pa.ListArray:
    """Lines that begin with > turned to spaces."""
    x = lines_in(prose)
    begin = np.minimum(x.next_solid(x.low), x.high)
    quoted = (x.data[begin] == ord(">")) & (begin < x.high)
    if not quoted.any():
        return prose
    x.data[:-3][quoted[np.repeat(np.arange(len(x.low)), np.diff(x.at))]] = 0x20
    return with_bytes(prose, x)


def prose_of(lines: list[str]) -> list[str]:
    """Prose lines of one markdown text."""
    return cleared(pa.array([lines], pa.list_(pa.string())), np.array([True])).to_pylist()[0]


_CODE = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?$)|//', re.DOTALL)


def slash_comment(line: str) -> str | None:
    """What follows the first // outside a double-quoted string."""
    return next((line[m.end() :] for m in _CODE.finditer(line) if m[0] == "//"), None)


def slash_lines(lines: list[str]) -> list[str]:
    """Comment lines of a source with // and /* */ comments."""
    out, block = [], False
    for line in (x.lstrip() for x in lines):
        if block:
            head, end, _ = line.partition("*/")
            block = not end
            if block or (head + end).strip():
                out.append((head + end).strip() if end else line)
            continue
        tail = slash_comment(line)
        if tail and tail.strip():
            out.append(tail.strip())
        if line.startswith("/*"):
            body, end, _ = line[2:].partition("*/")
            if not end:
                # the opening also ends where its own star meets a slash
                block = "*/" not in line
            if body.strip() and (end or block):
                out.append(body.strip())
    return out


def told_lines(lines: pa.ListArray, kind: pa.Array, exempt_quotes: bool = False) -> pa.ListArray:
    """The prose lines of a batch: lists of a text's lines (of hash comments' texts for that kind) by kind."""
    kinds = np.array(kind.to_pylist(), dtype=object)
    if (kinds == "slash-source").any():
        texts = [slash_lines(x) if k == "slash-source" else x for x, k in zip(lines.to_pylist(), kinds, strict=True)]
        lines = pa.array(texts, pa.list_(pa.string()))
    out = cleared(lines, np.isin(kinds, PROSE_KINDS))
    return without_quotes(out) if exempt_quotes else out


def hash_lines(lines: Column) -> Column:
    """Texts of lines that begin with # and not with #!; empty ones go."""
    found = F.filter(F.transform(lines, strip_start), lambda x: x.startswith("#") & ~x.startswith("#!"))
    return F.filter(F.transform(found, lambda x: strip(F.substring(x, 2, F.length(x)))), lambda x: x != "")


#: Kinds whose texts hold prose.
LINTED = (*PROSE_KINDS, "slash-source", "hash-source")


def kind_lines(kind: Column, text: Column) -> Column:
    """What told_lines takes: the lines of a text, for hash comments their texts."""
    lines = lines_of(text)
    return F.when(kind == "hash-source", hash_lines(lines)).otherwise(lines)


def with_lines(docs: DataFrame) -> DataFrame:
    """Documents (kind, text and others) of kinds that are linted, with their ``lines`` in place of text."""
    ready(docs.sparkSession)
    return docs.filter(F.col("kind").isin(*LINTED)).withColumn("lines", kind_lines(F.col("kind"), F.col("text"))).drop("text")


def prose_arrays(docs: DataFrame, exempt_quotes: bool = False) -> DataFrame:
    """``docs`` (kind, text and others) with ``prose``, the array of prose lines, in place of text."""

    def run(lines: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.concat_arrays([told_lines(lines.slice(a, b - a), kind.slice(a, b - a), exempt_quotes) for a, b in slices(lines)])

    return with_lines(docs).withColumn("prose", F.arrow_udf(run, "array<string>")("lines", "kind")).drop("lines")


def prose_lines(docs: DataFrame, exempt_quotes: bool = False) -> DataFrame:
    """doc_id, kind, line_no (from 1) and text of each prose line."""
    arrays = prose_arrays(docs.select("doc_id", "kind", "text"), exempt_quotes)
    return arrays.select("doc_id", "kind", F.posexplode_outer("prose").alias("p", "text")).filter("p is not null").select("doc_id", "kind", (F.col("p") + 1).cast("long").alias("line_no"), "text")
