"""Gates over batches of tool calls and over replies; texts are linted in their rows, only verdicts are grouped."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearprose.config import LintConfig
from clearprose.operators.classify import path_kind
from clearprose.operators.diff import apply_edit
from clearprose.operators.report import feedback
from clearprose.operators.shell import commit_messages
from clearprose.plans.lint import with_found, with_found_in_change
from clearprose.session import ready

MAX_GATES, KEPT_IDENTITIES = 3, 16
# The texts that gates put out.
UNCHECKED = "Writing rules could not check the git commit message. Use git commit with a static -m or --message argument."
BLOCKED, WARNED, HARD_IN, SOFT_IN = "Writing rules blocked", "Writing-rule warnings for", "Writing-rule violations in", "Writing-rule warnings in"
CHECKED = "[simple-english] Post-check of files changed by this command.\n"
TO_DO = "Fix the hard violations. A later write to a listed file re-runs this check until the file is clean."
REPLY_STATE = "hard bigint, soft bigint, last_identity string, gate_count int, gated_replies array<string>"


def of_severity(violations: Column, severity: str) -> Column:
    return F.filter(violations, lambda v: v["severity"] == severity)


def check_calls(calls: DataFrame, files: DataFrame, config: LintConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocked, warnings) of write, edit and bash calls; other tools pass.

    ``calls`` has call_id, name and arguments (a struct of file_path, path, content,
    old_string, new_string, replace_all and command), ``files`` path and content. An edit that can't be
    applied passes; one of a missing file is judged by its new string alone.
    """
    ready(calls.sparkSession)
    a = lambda c: F.col(f"arguments.{c}")
    text = lambda c: F.coalesce(a(c), F.lit(""))
    known = files.select(F.col("path").alias("file_path"), F.col("content").alias("held"))
    told = calls.filter("name in ('write', 'edit')").withColumn("file_path", text("file_path")).join(known, "file_path", "left")
    told = told.withColumn("edit", apply_edit(F.col("held"), text("old_string"), text("new_string"), F.coalesce(a("replace_all"), F.lit(False))))
    new = F.when(F.col("name") == "write", text("content")).when(F.col("held").isNull(), text("new_string")).otherwise(F.col("edit.result"))
    shown = F.coalesce(a("file_path"), a("path"), F.lit("file")).alias("path")
    judged = told.withColumn("new", new).filter("new is not null").withColumn("kind", path_kind(F.col("file_path")))
    judged = with_found_in_change(judged, F.col("kind"), F.col("new"), F.col("held"), config).select("call_id", shown, F.col("changed").alias("found"))

    commits = commit_messages(calls.filter("name = 'bash'").select("call_id", text("command").alias("command")))
    read = with_found(commits, F.when(F.col("dynamic"), "skip").otherwise("commit-message"), F.col("message"), config)
    gathered = read.groupBy("call_id").agg(F.max("dynamic").alias("dynamic"), F.array_sort(F.collect_list(F.struct("ord", "found"))).alias("f"))
    messages = gathered.select("call_id", F.lit("commit message").alias("path"), F.flatten(F.transform("f", lambda x: x["found"])).alias("found"), "dynamic")
    judged = judged.withColumn("dynamic", F.lit(False)).unionByName(messages)

    hard, soft = of_severity(F.col("found"), "hard"), of_severity(F.col("found"), "soft")
    judged = judged.withColumn("hard", hard).withColumn("soft", soft)
    total = F.size("found")
    note = F.when(total > 1, F.concat(F.lit(" ("), total.cast("string"), F.lit(" total, "), F.size("hard").cast("string"), F.lit(" hard)"))).otherwise("")
    reason = F.when(F.col("dynamic"), UNCHECKED).otherwise(F.concat(F.lit(BLOCKED), note, F.lit("\n"), feedback(F.lit(""), F.col("path"), F.col("hard"))))
    blocked = judged.filter(F.col("dynamic") | (F.size("hard") > 0)).select("call_id", reason.alias("reason"))
    warned = judged.filter(~F.col("dynamic") & (F.size("hard") == 0) & (F.size("soft") > 0))
    return blocked, warned.select("call_id", feedback(F.lit(WARNED), F.col("path"), F.col("soft")).alias("warning"))


SECTION = "struct<hard:bigint,soft:boolean,text:string>"


def judged_files(seen: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """``seen`` (path, prev, content and others) with outcome, and what a check of the whole file and of its changed lines would say.

    Outcomes: gone (there is no file), same (nothing to check: unchanged, binary or skipped) and checked. ``whole`` and
    ``changed`` are structs of the number of hard violations and the section of the report (null text: none).
    """
    ready(seen.sparkSession)
    content, kind = F.col("content"), path_kind(F.col("path"))
    same = F.col("prev").eqNullSafe(content) | content.contains("\0") | (kind == "skip")
    told = seen.withColumn("outcome", F.when(content.isNull(), "gone").when(same, "same").otherwise("checked"))
    told = with_found_in_change(told, F.when(F.col("outcome") == "checked", kind).otherwise("skip"), content, F.col("prev"), config)

    def section(violations: str) -> Column:
        hard, soft = of_severity(F.col(violations), "hard"), of_severity(F.col(violations), "soft")
        text = F.when(F.size(hard) > 0, feedback(F.lit(HARD_IN), F.col("path"), hard)).when(F.size(soft) > 0, feedback(F.lit(SOFT_IN), F.col("path"), soft))
        return F.struct(F.size(hard).cast("bigint").alias("hard"), (F.size(hard) == 0).alias("soft"), text.alias("text"))

    return told.withColumn("whole", section("found")).withColumn("changed", section("changed")).drop("found", "prev", "content")


def report_of(sections: Column) -> Column:
    """The report of a call from its sections (soft, nth, text), hard ones first, in the order of mention; null without any."""
    ordered = F.array_sort(sections)
    body = F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), F.lit("\n"))
    return F.when(F.size(sections) > 0, F.concat(F.lit(CHECKED), body, F.lit(TO_DO)))


def post_check(snapshots: DataFrame, current: DataFrame, open_files: DataFrame, config: LintConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, open files) after commands ran.

    ``snapshots`` has call_id, path and prev and, where a batch has several calls, ord (the call's
    place) and nth (the mention's); ``current`` path and content of the files that exist, ``open_files`` path and hard.
    A changed file is checked where it changed, one with open violations as a whole. Calls of a batch
    follow one another: what a call opens or clears, the next call finds so. A check that finds violations, but none on changed
    lines, leaves a file as it was; every other outcome tells its state, so the last of
    those before a call does.
    """
    place = lambda c: F.col(c).cast("int") if c in snapshots.columns else F.lit(0)
    seen = snapshots.select("call_id", place("ord").alias("ord"), place("nth").alias("nth"), "path", "prev").join(current.select("path", "content"), "path", "left")
    seen = seen.join(open_files.select("path", F.col("hard").cast("bigint").alias("was")), "path", "left")
    order = Window.partitionBy("path").orderBy("ord", "call_id", "nth")
    checked = F.col("outcome") == "checked"
    tells = F.when(F.col("outcome") == "gone", False).when(checked & (F.col("whole.hard") == 0), False).when(checked & (F.col("changed.hard") > 0), True)
    before = F.last("tells", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = judged_files(seen, config).withColumn("tells", tells).withColumn("open", F.coalesce(before, F.col("was").isNotNull()))
    told = told.withColumn("said", F.when(F.col("open"), F.col("whole")).otherwise(F.col("changed")))
    count = F.when(F.col("outcome") == "gone", 0).when(checked, F.col("said.hard"))
    last = told.withColumn("count", count).groupBy("path").agg(F.max_by(F.when(F.col("count").isNotNull(), F.col("count")), F.when(F.col("count").isNotNull(), F.struct("ord", "call_id", "nth"))).alias("count"))
    left = open_files.select("path", F.col("hard").cast("bigint").alias("hard")).join(last, "path", "full").select("path", F.coalesce("count", "hard").alias("hard")).filter("hard > 0")
    sections = told.filter((F.col("outcome") == "checked") & F.col("said.text").isNotNull()).groupBy("call_id").agg(F.collect_list(F.struct("said.soft", "nth", "said.text")).alias("s"))
    return sections.select("call_id", report_of(F.col("s")).alias("report")), left


def spliced(results: DataFrame, reports: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Results (call_id, text, ...) with a call's report after its text and all else as it was; calls without a report don't appear.

    A call without a result of its own takes the one at its place, where ``calls`` (call_id, place)
    and the results' ``place`` tell it; otherwise the report follows an empty text.
    """
    whole = F.struct(*results.columns)
    told = reports.join(results.select("call_id", whole.alias("own")), "call_id", "left")
    base = F.col("own")
    if calls is not None:
        told = told.join(calls.select("call_id", "place"), "call_id", "left").join(results.select("place", whole.alias("beside")), "place", "left")
        base = F.coalesce("own", "beside")
    rest = [base[c].alias(c) for c in results.columns if c not in ("call_id", "text")]
    return told.select("call_id", F.concat(F.coalesce(base["text"], F.lit("")), F.lit("\n\n"), F.col("report")).alias("text"), *rest)


# Fixed values of the 64-bit FNV-1a hash.
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Texts that must still go on for a step over all of them to be cheaper than a loop over each.
_TOGETHER = 16


def identities_of(texts: list[str]) -> list[str]:
    """64-bit FNV-1a of each text's UTF-8 bytes, in hex; all texts take a byte at a time together while enough of them go on."""
    raw = [t.encode() for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    sizes = np.array([len(raw[i]) for i in order], np.int64)
    data, first = np.frombuffer(b"".join(raw[i] for i in order), np.uint8), np.cumsum(sizes) - sizes
    hashes = np.full(len(raw), _FNV_START, np.uint64)
    together = int(sizes[_TOGETHER - 1]) if len(raw) >= _TOGETHER else 0
    for at, live in enumerate(np.searchsorted(-sizes, -np.arange(together)).tolist()):
        hashes[:live] = (hashes[:live] ^ data[first[:live] + at]) * np.uint64(_FNV_PRIME)
    out = [""] * len(raw)
    for i, h in zip(order, hashes.tolist(), strict=True):
        for byte in raw[i][together:]:
            h = (h ^ byte) * _FNV_PRIME % 2**64
        out[i] = f"{h:016x}"
    return out


def identity_of(text: str) -> str:
    return identities_of([text])[0]


def _identities(texts: pd.Series) -> pd.Series:
    return pd.Series(identities_of(texts.tolist()))


def gate_step(state: dict, hard: int, soft: int, identity: str) -> tuple[dict, bool]:
    """The state after a reply, and whether the reply is sent back."""
    gated = state["gated_replies"]
    stop = hard > 0 and identity not in gated and state["gate_count"] < MAX_GATES
    count = state["gate_count"] + 1 if stop else state["gate_count"] if hard else 0
    kept = ([*gated, identity] if stop else gated)[-KEPT_IDENTITIES:]
    return {"hard": hard, "soft": soft, "last_identity": identity, "gate_count": count, "gated_replies": kept}, stop


def new_state() -> dict:
    return {"hard": 0, "soft": 0, "last_identity": None, "gate_count": 0, "gated_replies": []}


def follow_up(hard_text, soft_text, hard, soft):
    """The message that asks for a corrected reply."""
    note = F.when(soft > 0, F.concat(F.lit(", "), soft.cast("string"), F.lit(" soft"))).otherwise("")
    # fixed value
    ask = (
        ". Re-send the complete reply, in full, with every flagged issue below fixed. Do not reply with only the changed lines. "
        "Keep the same meaning and content; change only what the flagged issues require. Do not re-run, re-verify, or redo the work. "
        "Do not answer your own open questions as if the user replied.\n\nHard violations:\n"
    )
    more = F.when(soft > 0, F.concat(F.lit("\n\nSoft violations (warnings):\n"), soft_text)).otherwise("")
    return F.concat(F.lit("Your last reply had "), hard.cast("string"), F.lit(" hard writing-rule violation(s)"), note, F.lit(ask), hard_text, more)


def last_replies(events: DataFrame) -> DataFrame:
    """session, seq and content of each session's last assistant message with content.

    The last one is that of the greatest ``place`` (of the greatest seq, where events have no place).
    """
    some = events.filter("type = 'assistant_message' and trim(content) <> ''")
    by = "place" if "place" in events.columns else "seq"
    return some.groupBy("session").agg(F.max_by(F.struct("seq", "content"), by).alias("m")).select("session", "m.*")


def linted_replies(replies: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Replies (session, seq, content) with hard and soft counts and the follow-up message, told in each reply's row."""
    ready(replies.sparkSession)
    told = with_found(replies, F.lit("prose-file"), F.col("content"), config)
    told = told.withColumn("h", of_severity(F.col("found"), "hard")).withColumn("s", of_severity(F.col("found"), "soft"))
    n = lambda c: F.size(c).cast("bigint")
    text = lambda c: feedback(F.lit(""), F.lit("reply"), F.col(c))
    return told.select("session", "seq", "content", follow_up(text("h"), text("s"), n("h"), n("s")).alias("message"), n("h").alias("hard"), n("s").alias("soft"))


def with_identity(linted: DataFrame) -> DataFrame:
    """session, seq, identity, hard, soft and others of linted replies: identities of a batch are hashed together, texts go no further."""
    identity = F.pandas_udf(_identities, "string")(F.coalesce("content", F.lit("")))
    return linted.withColumn("identity", identity).drop("content")


_REPLY = "seq bigint, identity string, hard bigint, soft bigint"
_VERDICT = "seq:bigint,hard:bigint,soft:bigint,gated:boolean,gate_count:int"


def _folded(sessions: pa.Array) -> pa.Array:
    """The verdicts of the replies of each session, in order of seq; the sessions of a batch are read together."""
    replies = sessions.flatten()
    columns = [replies.field(c.split()[0]).to_pylist() for c in _REPLY.split(", ")]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(sessions), 0).to_numpy()).tolist()
    out, first = [], 0
    for end in ends:
        state = new_state()
        for seq, identity, hard, soft in sorted(zip(*(c[first:end] for c in columns), strict=True), key=lambda r: (r[0] is None, r)):
            state, stop = gate_step(state, hard, soft, identity)
            out.append((seq, hard, soft, stop, state["gate_count"]))
        first = end
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    named = [f.split(":") for f in _VERDICT.split(",")]
    rows = pa.StructArray.from_arrays([pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(named)], [n for n, _ in named])
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), rows)


def gate_replies(linted: DataFrame) -> DataFrame:
    """Each reply in its session's order: gated or not, and the count of gates in a row.

    A session's identities and counts are one array; sessions pass through Python in batches.
    """
    ready(linted.sparkSession)
    told = with_identity(linted).groupBy("session").agg(F.collect_list(F.struct(*[c.split()[0] for c in _REPLY.split(", ")])).alias("replies"))
    return told.select("session", F.inline_outer(F.arrow_udf(_folded, f"array<struct<{_VERDICT}>>")("replies"))).filter("hard is not null")
