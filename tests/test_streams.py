"""Keyed streams equal their batch folds, over several micro-batches."""

import random
import tempfile

import pandas as pd

from clearprose.config import LintConfig
from clearprose.operators import gate
from clearprose.streaming import follow_ups, open_files, reply_gate, snapshots
from clearprose.streaming.state import drained
from tests.test_gate import WANT, replies


def stream_of(spark, frames):
    """A stream with a micro-batch for each frame."""
    folder = tempfile.mkdtemp()
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_reply_gate(spark):
    some = replies(spark)
    stream = stream_of(spark, [some.filter(f"seq {x}") for x in ("< 3", "between 3 and 4", "> 4")])
    got = drained(reply_gate.gate_stream(gate.linted_replies(stream))).orderBy("seq").collect()
    assert [(r.seq, r.gated, r.gate_count) for r in got] == WANT
    assert all((r.message is not None) == r.gated for r in got)


def test_reply_gate_keeps_odd_rows(spark):
    """Sessions and places without a value, and places that no float holds beside such a one; null places come last."""
    big, schema = 2**53 + 1, "session string, seq bigint, content string, message string, hard bigint, soft bigint"
    first = [("a", None, "y;", "m2", 1, 0), ("a", big, "x;", "m1", 1, 0), (None, 1, "x;", "m3", 1, 2)]
    later = [("a", big + 2, "x;", "m4", 1, 0), (None, 2, "fine", "m5", 0, 0)]
    stream = stream_of(spark, [spark.createDataFrame(rows, schema) for rows in (first, later)])
    got = drained(reply_gate.gate_stream(stream)).select("session", "seq", "soft", "gated", "gate_count", "message").collect()
    want = [("a", big, 0, True, 1, "m1"), ("a", None, 0, True, 2, "m2"), ("a", big + 2, 0, False, 2, None), (None, 1, 2, True, 1, "m3"), (None, 2, 0, False, 0, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def brute_open(rows):
    """Sections and open files of checks in order, by one lint of each text."""
    state, out = {}, []
    for r in rows:
        at = (r["session"], r["path"])
        if r["content"] is None:
            state.pop(at, None)
            out.append((*at, r["batch"], r["ord"], 0))
            continue
        if r["content"] == r["prev"]:
            continue
        lines, old = r["content"].split("\n"), (r["prev"] or "").split("\n")
        whole = sum(";" in x for x in lines)
        changed = sum(";" in x for x in lines if x not in old)
        hard = whole if at in state or r["prev"] is None else changed
        if hard:
            state[at] = hard
        else:
            state.pop(at, None)
        out.append((*at, r["batch"], r["ord"], hard))
    return sorted(out), {k: v for k, v in state.items()}


def test_open_files_follow_batches(spark):
    rng, rows = random.Random(6), []
    for batch in range(3):
        for call in range(6):
            k = f"{batch}-{call}"
            old = [f"own {k} first", "Bad; old." if rng.random() < 0.4 else "Fine old.", f"own {k} last"]
            new = old[:2] + ([f"Bad; new {k}."] if rng.random() < 0.4 else [f"fine new {k}"]) + old[2:]
            content = None if rng.random() < 0.15 else "\n".join(new if rng.random() < 0.8 else old)
            rows.append({"session": f"s{call % 2}", "batch": batch, "ord": call, "call_id": f"c{k}", "nth": 0, "path": f"f{rng.randrange(2)}.md", "prev": "\n".join(old) if rng.random() < 0.9 else None, "content": content})
    schema = "session string, batch int, ord int, call_id string, nth int, path string, prev string, content string"
    only = LintConfig(rules={r: "off" for r in ("sentence-length", "paragraph-length")})
    stream = stream_of(spark, [spark.createDataFrame([r for r in rows if r["batch"] == b], schema) for b in range(3)])
    got = drained(open_files.open_files_stream(stream, only)).collect()
    want, state = brute_open(rows)
    assert sorted((r.session, r.path, r.batch, r.ord, r.hard) for r in got) == want
    last = {}
    for r in sorted(got, key=lambda r: (r.batch, r.ord)):
        last[(r.session, r.path)] = r.hard
    assert {k: v for k, v in last.items() if v} == state and any(r.text for r in got)


def test_snapshots_are_read_once(spark):
    schema = "session string, batch int, at int, ord int, call_id string, nth int, path string, prev string, content string"
    one = [("s", 1, 0, 0, "c1", 0, "a.md", "old a", None), ("s", 1, 0, 1, "c2", 0, "b.md", None, None)]
    end = [("s", 1, 1, 0, "c1", 0, "a.md", None, "new a"), ("s", 1, 1, 1, "c2", 0, "b.md", None, "new b")]
    again = [("s", 2, 1, 0, "c1", 0, "a.md", None, "newer a"), ("t", 2, 1, 0, "c1", 0, "a.md", None, "other session")]
    replaced = [("s", 3, 0, 0, "c4", 0, "d.md", "d", None), ("s", 4, 0, 0, "c5", 0, "e.md", "e", None), ("s", 4, 1, 0, "c5", 0, "e.md", None, None), ("s", 4, 1, 0, "c4", 0, "d.md", None, "x")]
    stream = stream_of(spark, [spark.createDataFrame(x, schema) for x in (one, end, again, replaced)])
    got = drained(snapshots.consumed_snapshots(stream)).collect()
    assert sorted((r.batch, r.call_id, r.path, r.prev, r.content) for r in got) == [(1, "c1", "a.md", "old a", "new a"), (1, "c2", "b.md", None, "new b"), (4, "c5", "e.md", "e", None)]


class Held:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def iterator(self):
        self.asked += 1
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self.rows[key] = value

    def clear(self):
        self.asked += 1
        self.rows = {}


def test_snapshots_of_many_batches_ask_the_state_once():
    processor = snapshots.Snapshots()
    processor.held = Held()
    names = ["batch", "at", "ord", "call_id", "nth", "path", "prev", "content"]
    told = []
    for first in (0, 500):  # the last batch of each group of rows ends in the next
        rows = [(b, 0, 0, f"c{b}", 0, f"{b}.md", f"old {b}", None) for b in range(first, first + 500)] + [(b, 1, 0, f"c{b}", 0, f"{b}.md", None, None if b % 2 else "new") for b in range(max(0, first - 1), first + 499)]
        told += [r for frame in processor.handleInputRows(("s",), iter([pd.DataFrame(rows[:300], columns=names), pd.DataFrame(rows[300:], columns=names)]), None) for r in frame.itertuples(index=False)]
    assert [tuple(r) for r in told] == [("s", b, 0, f"c{b}", 0, f"{b}.md", f"old {b}", None if b % 2 else "new") for b in range(999)]
    assert processor.held.rows == {(0, 0): ("c999", "999.md", "old 999")} and processor.held.asked <= 6


def test_follow_ups_of_a_replayed_batch_are_there_once(spark):
    path, checkpoint = tempfile.mkdtemp(), tempfile.mkdtemp()
    verdicts = reply_gate.gate_stream(gate.linted_replies(stream_of(spark, [replies(spark)])))
    follow_ups.follow_up_sink(verdicts, path, checkpoint).awaitTermination()
    written = follow_ups.follow_ups(spark, path)
    assert written.count() == 4 and {r.queue for r in written.collect()} == {"follow"} and {r.type for r in written.collect()} == {"user_message"}
    gated = spark.createDataFrame([("s", "again"), ("s", None)], "session string, message string")
    for _ in range(2):  # the same batch twice
        follow_ups.write_follow_ups(gated, 7, path)
    assert follow_ups.follow_ups(spark, path).filter("batch = 7").count() == 1
    assert follow_ups.follow_ups(spark, path).count() == 5
