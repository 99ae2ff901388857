"""The lifecycle windows, each a function over DataFrames; the caller's engine passes the state between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.config import LintConfig
from clearprose.functions.prompt import rule_summary, with_fragment
from clearprose.operators import gate, shell

FRAGMENT = "simple-english"


def tool_before(calls: DataFrame, files: DataFrame, config: LintConfig, cwd: str = "", home: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocked, warnings, snapshots) of a batch of calls; the snapshots are the state for ``tool_after``."""
    blocked, warnings = gate.check_calls(calls, files, config)
    place = ["ord"] if "ord" in calls.columns else []
    commands = calls.filter("name = 'bash'").select("call_id", *place, F.col("arguments.command").alias("command"), F.lit(cwd).alias("cwd"))
    return blocked, warnings, shell.snapshots(commands, files, home)


def tool_after(snapshots: DataFrame, current: DataFrame, open_files: DataFrame, results: DataFrame, config: LintConfig, calls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rewritten results, open files) after the calls ran; ``calls`` (call_id, ord) tells whose result stands at whose place."""
    reports, left = gate.post_check(snapshots, current, open_files, config)
    places = calls.select("call_id", F.col("ord").alias("place")) if calls is not None else None
    return gate.spliced(results, reports, places), left


def model_before(prompts: DataFrame, config: LintConfig) -> DataFrame:
    """Prompts whose ``input``, an array of (name, text) fragments, ends with the rule summary."""
    return prompts.withColumn("input", with_fragment(F.col("input"), FRAGMENT, rule_summary(config)))


def run_idle(replies: DataFrame, config: LintConfig) -> DataFrame:
    """Gated replies with the message that sends each back."""
    linted = gate.linted_replies(replies, config)
    gated = gate.gate_replies(linted).filter("gated").select("session", "seq")
    return linted.join(gated, ["session", "seq"])


WINDOWS: dict[str, Callable] = {"tool.before": tool_before, "tool.after": tool_after, "model.before": model_before, "run.idle": run_idle}
