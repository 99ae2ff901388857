"""Session logs as a data source, read whole or tailed as a stream.

A log is ``<root>/<session>/events.jsonl``, plain or compressed (.gz, .zst). Every line that ends is a row with
its place: its byte offset in the (decoded) log, a total order that no sequence number of an event
changes. A stream's offset is the byte after the last whole line of each plain log; compressed logs are
finished and read once. A log that can't be read gives a row that says so, and a session folder
without a log another, so a session without replies is told from one whose replies can't be known.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from clearprose.session import ready

SCHEMA = "session string, outcome string, place bigint, seq bigint, type string, ts string, content string, queue string"
LOG = "events.jsonl"
_ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])
#: Most rows of a batch, and characters of content after which one ends.
_BATCH_ROWS, _BATCH_CHARS = 2048, 1 << 22
#: Tasks that read a folder of sessions where nothing else is said.
TASKS = 64
#: Bytes at a log's end that are looked at for its last line feed at a time.
_STEP = 1 << 16


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def _folders(root: str) -> list[str]:
    if not os.path.isdir(_local(root)):
        return []
    with os.scandir(_local(root)) as found:
        return sorted(e.path for e in found if not e.name.startswith(".") and e.is_dir())


def log_of(folder: str) -> str | None:
    return next((p for p in (os.path.join(folder, LOG + e) for e in ("", ".gz", ".zst")) if os.path.exists(p)), None)


def whole_lines(path: str) -> int:
    """The byte after the last line feed."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            low = max(0, end - _STEP)
            f.seek(low)
            at = f.read(end - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return 0


def _bytes(path: str, low: int, high: int | None) -> bytes:
    if path.endswith(".gz"):
        with gzip.open(path) as f:
            return f.read()
    if path.endswith(".zst"):
        with pa.input_stream(path, compression="zstd") as f:
            return f.read()
    with open(path, "rb") as f:
        f.seek(low)
        return f.read() if high is None else f.read(high - low)


def events_in(raw: bytes, low: int = 0) -> Iterator[tuple]:
    """(place, seq, type, ts, content, queue) of each line that is a JSON object."""
    at = low
    for line in raw.split(b"\n"):
        place, at = at, at + len(line) + 1
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if isinstance(e, dict):
            text = lambda k: e.get(k) if isinstance(e.get(k), str) else None  # noqa: B023, E731
            seq = e.get("seq")
            yield place, seq if type(seq) is int and -(1 << 63) <= seq < 1 << 63 else None, text("type"), text("ts"), text("content"), text("queue")


class _Part(InputPartition):
    def __init__(self, folder: str, path: str | None, low: int = 0, high: int | None = None):
        self.folder, self.path, self.low, self.high = folder, path, low, high


def _rows(part: _Part) -> Iterator[tuple]:
    session = os.path.basename(part.folder)
    if part.path is None:
        yield session, "absent", None, None, None, None, None, None
        return
    try:
        raw = _bytes(part.path, part.low, part.high)
        raw.decode()
    except (OSError, EOFError, ValueError, pa.ArrowException):
        yield session, "unreadable", None, None, None, None, None, None
        return
    for event in events_in(raw, part.low):
        yield session, "event", *event


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in Arrow batches of a few texts' size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[6] or "")
        if len(some) >= _BATCH_ROWS or size >= _BATCH_CHARS:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class SessionLogs(DataSource):
    """Format ``session_log`` with the option ``path``, the folder of sessions."""

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tasks", TASKS)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(self.options["path"])


class _Folders(InputPartition):
    """Folders of one task."""

    def __init__(self, folders: list[str]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[_Folders]:
        """Folders dealt in turn to a few tasks; each task looks up its own logs."""
        found = _folders(self.root)
        return [_Folders(found[i :: self.tasks]) for i in range(min(self.tasks, len(found)))]

    def read(self, partition: _Folders | None) -> Iterator[pa.RecordBatch]:
        folders = partition.folders if partition else []  # without folders Spark reads once with no partition
        yield from _batches(row for d in folders for row in _rows(_Part(d, log_of(d))))


class _Tail(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        logs = {d: log_of(d) for d in _folders(self.root)}
        return {d: whole_lines(p) if p.endswith(LOG) else -1 for d, p in logs.items() if p}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        grown = [(d, start.get(d, 0), high) for d, high in end.items() if start.get(d, 0) != high]
        return [_Part(d, log_of(d), max(0, low), None if high < 0 else high) for d, low, high in grown]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _rows(partition)


def session_logs(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the logs below ``root``."""
    ready(spark).dataSource.register(SessionLogs)
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("session_log").option("path", root).option("tasks", tasks).load()


def session_log_stream(spark: SparkSession, root: str) -> DataFrame:
    """Events of the logs below ``root`` as their lines come in."""
    ready(spark).dataSource.register(SessionLogs)
    return spark.readStream.format("session_log").option("path", root).load().filter("outcome = 'event'")


def last_reply_outcomes(logs: DataFrame) -> DataFrame:
    """session, outcome and content: the last assistant message with content (event), no such message (none), or why there is none (absent, unreadable)."""
    said = F.when((F.col("type") == "assistant_message") & (F.regexp_replace("content", r"(?U)\s", "") != ""), F.col("content"))
    told = logs.withColumn("said", said).groupBy("session").agg(
        F.max_by("said", F.when(F.col("said").isNotNull(), F.col("place"))).alias("content"),
        F.max(F.when(F.col("outcome") != "event", F.col("outcome"))).alias("why"),
    )
    outcome = F.coalesce("why", F.when(F.col("content").isNotNull(), "event"), F.lit("none"))
    return told.select("session", outcome.alias("outcome"), F.when(F.col("why").isNull(), F.col("content")).alias("content"))


def write_logs(events: DataFrame, root: str) -> None:
    """Writes events (session, turn and the events' own fields) as logs below ``root``, each session's lines in the order of turn.

    A session's lines go to its folder from one task; the log is complete where it has its final name.
    """
    fields = [c for c in events.columns if c not in ("session", "turn")]
    lines = events.select(F.col("session").cast("string").alias("session"), "turn", F.to_json(F.struct(*fields)).alias("line"))
    base = _local(root)

    def write(rows):
        import pandas as pd

        folder = out = None
        for frame in rows:
            for r in frame.itertuples():
                if r.session != folder:
                    if out:
                        _closed(out, base, folder)
                    folder = r.session
                    os.makedirs(os.path.join(base, folder), exist_ok=True)
                    out = open(os.path.join(base, folder, f".{LOG}"), "w", encoding="utf-8")
                out.write(r.line + "\n")
        if out:
            _closed(out, base, folder)
        yield pd.DataFrame({"n": [1]})

    lines.repartition("session").sortWithinPartitions("session", "turn").mapInPandas(write, "n int").write.format("noop").mode("overwrite").save()


def _closed(out, base: str, folder: str) -> None:
    out.close()
    os.replace(out.name, os.path.join(base, folder, LOG))
