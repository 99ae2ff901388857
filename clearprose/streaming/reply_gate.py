"""The reply gate as a stateful stream, one state for each session in RocksDB.

Texts are linted and hashed in the micro-batch, before rows are dealt by session: the
state sees counts and identities only. A session's state is one value and a list of at
most KEPT_IDENTITIES identities.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clearprose.operators.gate import gate_step, new_state, with_identity
from clearprose.session import ready
from clearprose.streaming.state import keyed_state

OUTPUT = "session string, seq bigint, hard bigint, soft bigint, gated boolean, gate_count int, message string"
_VERDICT = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


class ReplyGate(StatefulProcessor):
    """Replies of a session in order of seq (null ones last), each sent back or let through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("gate", "hard bigint, soft bigint, last_identity string, gate_count int")
        self.gated = handle.getListState("gated", "identity string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = new_state()
        if (held := self.value.get()) is not None:  # a new session has no list either
            state |= dict(zip(("hard", "soft", "last_identity", "gate_count"), held, strict=True))
            state["gated_replies"] = [x[0] for x in self.gated.get()]
        before = state["gated_replies"]
        # last first, so that what a row holds goes with its verdict
        told = sorted(map(tuple, rows), key=lambda r: float("inf") if r[1] is None else r[1])[::-1]
        while told:
            _, seq, identity, hard, soft, message = told.pop()
            state, stop = gate_step(state, hard, soft, identity)
            yield _VERDICT(key[0], seq, hard, soft, stop, state["gate_count"], message if stop else None)
        self.value.update((state["hard"], state["soft"], state["last_identity"], state["gate_count"]))
        if state["gated_replies"] != before:
            self.gated.put([(x,) for x in state["gated_replies"]])

    def close(self) -> None:
        pass


def gate_stream(linted: DataFrame) -> DataFrame:
    """Verdicts on a stream of linted replies (session, seq, content, message, hard, soft); gated ones carry the message that sends them back."""
    ready(linted.sparkSession)
    told = with_identity(linted).selectExpr("cast(session as string) as session", "seq", "identity", "hard", "soft", "case when hard > 0 then message end as message")  # only a reply with hard violations is sent back
    return keyed_state(told.groupBy("session"), ReplyGate(), OUTPUT, frames=False)
