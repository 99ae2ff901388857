"""Snapshots that a call leaves for its end, read once, as keyed state.

A session's map holds the snapshots of its last batch of calls; a new batch with
snapshots replaces them, the end of a batch reads and clears them. What no end
ever reads expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clearprose.streaming.state import keyed_state

#: Milliseconds after which snapshots that nobody reads go.
LIFE = 24 * 3600 * 1000
OUTPUT = "session string, batch bigint, ord int, call_id string, nth int, path string, prev string, content string"


class Snapshots(StatefulProcessor):
    def __init__(self, life: int = LIFE):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("snapshots", "ord int, nth int", "call_id string, path string, prev string", ttlDurationMs=self.life)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, before = [], dict(self.held.iterator())
        held, changed = before, False
        events = pd.concat(list(rows)).astype(object)
        events = events.where(events.notna(), None).sort_values(["batch", "at", "ord", "nth"], kind="stable")
        # batches of the group follow one another over a dictionary; the state is read and written once
        for (batch, at), group in groupby(events.itertuples(), attrgetter("batch", "at")):
            some, changed = list(group), True
            if at == 0:  # before the calls
                held = {(int(r.ord), int(r.nth)): (r.call_id, r.path, r.prev) for r in some}
                continue
            now = {r.path: r.content for r in some}
            ended = {r.call_id for r in some}
            for (n, nth), (call, path, prev) in sorted(held.items()):
                if call in ended:
                    out.append((key[0], batch, n, call, nth, path, prev, now.get(path)))
            held = {}
        if changed and (before or held):
            if before:
                self.held.clear()
            for place, snapshot in held.items():
                self.held.updateValue(place, snapshot)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def consumed_snapshots(events: DataFrame, life: int = LIFE) -> DataFrame:
    """Files that ended calls had seen, with the text from before and now.

    ``events`` is a stream of (session, batch, at, ord, call_id, nth, path, prev, content): at 0 a call's snapshot of a
    file (prev), at 1 the end of a call with a file as it is now (content, null where there is none).
    """
    told = events.selectExpr("cast(session as string) as session", "cast(batch as bigint) as batch", "cast(at as int) as at", "cast(ord as int) as ord", "cast(call_id as string) as call_id", "cast(nth as int) as nth", "path", "prev", "content")
    return keyed_state(told.groupBy("session"), Snapshots(life), OUTPUT, "ProcessingTime")
