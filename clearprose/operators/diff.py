"""Edits, and the lines that a change touches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_edit(content: Column, old: Column, new: Column, everywhere: Column) -> Column:
    """struct<result, error>: a literal replacement; several places need ``everywhere``."""
    times = F.when(old == "", 0).otherwise((F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)).cast("int")
    at = F.position(old, content)
    once = F.concat(F.substring(content, F.lit(1), at - 1), new, F.substring(content, at + F.length(old), F.length(content)))
    error = (
        F.when(old == "", "old_string is empty")
        .when(times == 0, "old_string not found")
        .when((times > 1) & ~everywhere, F.concat(F.lit("old_string found "), times.cast("string"), F.lit(" times")))
    )
    result = F.when(error.isNull(), F.when(everywhere, F.replace(content, old, new)).otherwise(once))
    return F.struct(result.alias("result"), error.alias("error"))


def changed_lines(old: list[str], new: list[str]) -> list[int]:
    """1-based new lines outside a shortest edit's equal lines; line ends count, the last line has none."""
    a = [x + "\n" for x in old[:-1]] + [x for x in old[-1:] if x]
    b = [x + "\n" for x in new[:-1]] + [x for x in new[-1:] if x]
    names = {line: i for i, line in enumerate(dict.fromkeys(a))}
    x, y = np.array([names[v] for v in a], np.int64), np.array([names.get(v, -1) for v in b], np.int64)
    # a line that the other side doesn't hold is never an equal one
    left, right = np.flatnonzero(np.isin(x, y)), np.flatnonzero(y >= 0)
    out = np.ones(len(b), bool)
    for i, n in _equal_runs(x[left], y[right]):
        out[right[i : i + n]] = False
    return (np.flatnonzero(out) + 1).tolist()


def _equal_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Runs (start, length) of y that a longest common subsequence with x takes, in memory in proportion to both.

    The middle of a shortest edit is found from both ends; what lies on its two sides is divided further.
    """
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        n = min(b - a, d - c)
        differ = np.flatnonzero(x[a : a + n] != y[c : c + n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(x[b - n + head : b][::-1] != y[d - n + head : d][::-1])
        tail = int(differ[0]) if len(differ) else n - head
        out += [run for run in ((c, head), (d - tail, tail)) if run[1]]
        a, b, c, d = a + head, b - tail, c + head, d - tail
        if a < b and c < d:
            i, j = _middle(x[a:b], y[c:d])
            todo += [(a, a + i, c, c + j), (a + i, b, c + j, d)]
    return out


def _advanced(reach: np.ndarray, cost: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The furthest places in x on each diagonal after one more edit, and these diagonals; -1 beyond the ends."""
    n, m = len(x), len(y)
    low, high = (-cost if cost <= m else -m + (m - cost) % 2), (cost if cost <= n else n - (n - cost) % 2)
    k = np.arange(low, high + 1, 2)
    above, below = reach[k + m + 2], reach[k + m]
    i = np.maximum(above, np.where(below >= 0, below + 1, -1))
    i = np.where((i < 0) | (i > n) | (i - k > m), -1, i)
    on = np.flatnonzero((i >= 0) & (i < n) & (i - k < m))
    while len(on):
        on = on[x[i[on]] == y[i[on] - k[on]]]
        i[on] += 1
        on = on[(i[on] < n) & (i[on] - k[on] < m)]
    return i, k


def _middle(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """A place (i, j) on a shortest edit from x to y, about half of its edits from each end."""
    n, m = len(x), len(y)
    ahead, back = (np.full(n + m + 3, -1, np.int64) for _ in range(2))
    ahead[m + 2] = back[m + 2] = 0  # diagonal 1, before the first edit
    rx, ry = x[::-1].copy(), y[::-1].copy()
    for cost in range((n + m + 1) // 2 + 1):
        for reach, other, p, q, odd in ((ahead, back, x, y, 1), (back, ahead, rx, ry, 0)):
            i, k = _advanced(reach, cost, p, q)
            reach[k + m + 1] = i
            if (n - m) % 2 == odd:
                # the same diagonal, seen from the other end
                far = n - m - k
                seen = (np.abs(far) <= cost - odd) & (far >= -m) & (far <= n) & (i >= 0)
                met = np.flatnonzero(seen)[i[seen] + other[far[seen] + m + 1] >= n]
                if len(met):
                    at, on = int(i[met[0]]), int(k[met[0]])
                    return (at, at - on) if odd else (n - at, m - (at - on))
    raise AssertionError("the ends always meet")


def changed_between(old: pa.ListArray, new: pa.ListArray, whole: np.ndarray) -> pa.ListArray:
    """Changed lines of each text's prose; null where the text is new as a whole."""
    told = [None if w else [] if a.equals(b) else changed_lines(a.as_py(), b.as_py()) for a, b, w in zip(old, new, whole.tolist(), strict=True)]
    return pa.array(told, pa.list_(pa.int64()))


def edited_texts(edits: DataFrame) -> DataFrame:
    """doc_id, kind, new and old of edits (doc_id, kind, content, old_string, new_string, replace_all).

    An edit that can't be applied is left out; without content (a missing file) the
    new string alone is new.
    """
    told = edits.withColumn("edit", apply_edit(F.col("content"), F.col("old_string"), F.col("new_string"), F.coalesce("replace_all", F.lit(False))))
    told = told.filter("content is null or edit.error is null")
    return told.select("doc_id", "kind", F.when(F.col("content").isNull(), F.col("new_string")).otherwise(F.col("edit.result")).alias("new"), F.col("content").alias("old"))


def changed_column(old: Column, new: Column) -> Column:
    """The changed lines of two arrays of lines; a null old array is all new."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return changed_between(a, b, a.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "array<bigint>")(old, new)
