"""Shell commands: mentioned paths and commit messages."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from clearprose.functions.text import strip
from clearprose.operators.classify import path_kind
from clearprose.session import ready

# Fixed value: a path-like token, a dot and two to six letters.
PATH = r"[A-Za-z0-9._/~-]*\.[A-Za-z]{2,6}"
MAX_FILE_BYTES = 1_048_576
_MESSAGE = ArrayType(StructType([StructField("message", StringType()), StructField("dynamic", BooleanType())]))


def path_mentions(command: Column) -> Column:
    """Path-like tokens, each once, in the order they first appear."""
    return F.array_distinct(F.regexp_extract_all(command, F.lit(PATH), F.lit(0)))


def resolved_path(path: Column, folder: Column, home: str, session_folder: Column | None = None) -> Column:
    """An absolute path: relative ones lie in the session's folder where it has one, else in ``folder``.

    A ~ stands for the home folder; what follows it with a slash is absolute already, as joining paths has it.
    """
    beside = folder if session_folder is None else F.coalesce(strip(session_folder), folder)
    return (
        F.when(path.startswith("~/"), F.substring(path, F.lit(2), F.length(path)))
        .when(path.startswith("~"), F.concat(F.lit(home + "/"), F.substring(path, F.lit(2), F.length(path))))
        .when(path.startswith("/"), path)
        .otherwise(F.concat_ws("/", F.regexp_replace(beside, "/$", ""), path))
    )


def commits_of(command: str) -> list[tuple[str, bool]]:
    """(message, dynamic) of each git commit with a message argument; dynamic ones hold $ or a backtick."""
    try:
        words = shlex.split(command)
    except ValueError:
        return []
    out, at = [], 0
    while at + 1 < len(words):
        if words[at : at + 2] != ["git", "commit"]:
            at += 1
            continue
        at += 2
        while at < len(words):
            word = words[at]
            message = words[at + 1] if word in ("-m", "--message") and at + 1 < len(words) else None
            if word.startswith("--message="):
                message = word.removeprefix("--message=")
            if message is not None:
                out.append((message, "$" in message or "`" in message))
            if message is not None or not word.startswith("-") or word == "-":
                break
            at += 1
        at += 1
    return out


@F.pandas_udf(_MESSAGE)
def _commits_udf(command: pd.Series) -> pd.Series:
    return command.map(lambda c: [{"message": m, "dynamic": d} for m, d in commits_of(c)])


def commit_messages(commands: DataFrame) -> DataFrame:
    """call_id, ord, message and dynamic of each commit in ``commands`` (call_id, command)."""
    ready(commands.sparkSession)
    some = commands.filter(F.lower("command").contains("git commit"))  # a Python function would see every row
    rows = some.select("call_id", F.posexplode_outer(_commits_udf("command")).alias("ord", "c")).filter("ord is not null")
    return rows.select("call_id", "ord", "c.message", "c.dynamic")


def snapshots(commands: DataFrame, files: DataFrame, home: str = "") -> DataFrame:
    """call_id, ord, nth, path and prev of each lintable file a command mentions, in the order of mention.

    ``commands`` has call_id, command, cwd and, where known, ord (the call's place in its batch) and
    session_cwd; ``files`` path and content. A missing file has a null prev; skipped kinds
    and large files are left out; a path that two mentions name is there twice.
    """
    order = F.col("ord") if "ord" in commands.columns else F.lit(0)
    own = F.col("session_cwd") if "session_cwd" in commands.columns else None
    told = commands.select("call_id", order.cast("int").alias("ord"), "cwd", *([own] if own is not None else []), F.posexplode(path_mentions(F.col("command"))).alias("nth", "token"))
    told = told.withColumn("path", resolved_path(F.col("token"), F.col("cwd"), home, own)).filter(path_kind(F.col("path")) != "skip")
    held = told.select("call_id", "ord", "nth", "path").join(files, "path", "left")
    return held.filter(f"content is null or octet_length(content) <= {MAX_FILE_BYTES}").select("call_id", "ord", "nth", "path", F.col("content").alias("prev"))
