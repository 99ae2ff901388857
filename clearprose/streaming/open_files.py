"""Files with open violations as keyed state, one map from path to hard violations for each session.

A micro-batch holds checks of files after commands ran. Their texts are judged in their
rows (operators.gate.judged_files); the state sees, for each check, the outcome and what a check of the
whole file and of its changed lines would say, and sets, clears and looks up the file's entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clearprose.config import LintConfig
from clearprose.operators.gate import judged_files
from clearprose.streaming.state import keyed_state

OUTPUT = "session string, batch bigint, ord int, call_id string, nth int, path string, soft boolean, text string, hard bigint"


class OpenFiles(StatefulProcessor):
    """Checks of a session in the order of batches, calls and mentions; a row for each check that is made or clears a file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "hard bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values(["batch", "ord", "nth"], kind="stable").itertuples():
            path, soft, text, hard = (r.path,), None, None, 0
            is_open = self.files.containsKey(path)
            if r.outcome == "checked":
                said = "whole" if is_open else "changed"
                hard, soft, text = int(getattr(r, f"{said}_hard")), getattr(r, f"{said}_soft"), getattr(r, f"{said}_text")
            if hard:
                self.files.updateValue(path, (hard,))
            elif is_open:
                self.files.removeKey(path)
            out.append((key[0], r.batch, r.ord, r.call_id, r.nth, r.path, soft, text, hard))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def open_files_stream(seen: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Checks of a stream of files (session, batch, ord, call_id, nth, path, prev, content): section text and hard violations left open."""
    judged = judged_files(seen, config).filter("outcome <> 'same'")
    narrow = judged.select(
        F.col("session").cast("string").alias("session"), F.col("batch").cast("bigint").alias("batch"), F.col("ord").cast("int").alias("ord"), F.col("call_id").cast("string").alias("call_id"),
        F.col("nth").cast("int").alias("nth"), "path", "outcome", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("whole", "changed") for f in ("hard", "soft", "text")],
    )
    return keyed_state(narrow.groupBy("session"), OpenFiles(), OUTPUT)
