"""Texts, payloads, session logs and reports in and out."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearprose.operators.classify import kind_override, path_kind

#: A batch of tool calls as JSON.
PAYLOAD = (
    "window string, session string, calls array<struct<id:string,name:string,arguments:struct<"
    "file_path:string,path:string,content:string,old_string:string,new_string:string,replace_all:boolean,command:string>>>, "
    "results array<struct<id:string,is_error:boolean,value:struct<text:string>>>"
)
EVENT = "v int, type string, ts string, seq bigint, content string, queue string"


def text_files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """doc_id (the path), label, kind and text of whole files; a folder is read with what lies below it."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("label", F.col("_metadata.file_path"))
    chosen = F.lit(kind_override(kind)) if kind else path_kind(F.col("label"))
    return raw.select(F.col("label").alias("doc_id"), "label", chosen.alias("kind"), F.col("value").alias("text"))


def typed_text(spark: SparkSession, text: str, kind: str | None = None) -> DataFrame:
    """One text that was typed in, labelled -."""
    return spark.createDataFrame([("-", "-", kind_override(kind or "prose-file"), text)], "doc_id string, label string, kind string, text string")


def corpus(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", kind: str = "prose-file") -> DataFrame:
    """doc_id, kind and text of a Parquet table; only two columns are read."""
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.lit(kind).alias("kind"), F.col(text).alias("text"))


def spread(table: DataFrame) -> DataFrame:
    """The table dealt out to all cores where it has fewer splits than there are (a file of one row group); larger tables stay as they are read."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads parsed; text that is no JSON gives a row of nulls."""
    return raw.select(F.from_json(F.col(column), PAYLOAD).alias("p")).select("p.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    """session, ord, call_id, name and arguments of every call."""
    return parsed.select("session", F.posexplode("calls").alias("ord", "c")).select("session", "ord", F.coalesce("c.id", F.lit("")).alias("call_id"), F.coalesce("c.name", F.lit("")).alias("name"), "c.arguments")


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of session logs in JSON lines, by session (the file's folder); lines that aren't JSON are left out.

    ``place`` is the order of the file's lines, whatever the events' own sequence numbers say.
    """
    raw = spark.read.schema(EVENT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    kept = raw.withColumn("session", folder).withColumn("place", place).filter("_corrupt is null and type is not null")
    return kept.select("session", "seq", "place", "type", "ts", "content", "queue")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A conversations table (conv_id, turn, role, text) as session events."""
    kind = F.concat("role", F.lit("_message"))
    return conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("content"))


def follow_up_events(gated: DataFrame) -> DataFrame:
    """User messages that a log takes up for gated replies (session, message)."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return gated.select("session", F.lit(1).alias("v"), F.lit("user_message").alias("type"), now.alias("ts"), F.col("message").alias("content"), F.lit("follow").alias("queue"))


#: Columns of the states that are kept as JSON, by name.
STATES = {
    "reply": "session string, version int, hard bigint, soft bigint, last_identity string, gate_count int, gated_replies array<string>",
    "snapshots": "session string, version int, call_id string, ord int, nth int, path string, prev string",
    "open": "session string, path string, hard bigint",
}


def write_state(df: DataFrame, path: str, state: str) -> None:
    """Replaces a state's table; columns are those of STATES, missing ones null, version 1."""
    fields = [f.split(" ", 1) for f in STATES[state].split(", ")]
    value = lambda n, t: (F.lit(1) if n == "version" else F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
    df.select(*[value(n, t) for n, t in fields]).write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, state: str) -> DataFrame:
    """A state's table; rows that aren't JSON, or name no session, are left out."""
    return spark.read.schema(STATES[state]).json(path).filter("session is not null")


def session_folder(named: str | None, environment: dict[str, str], cwd: str = "") -> str | None:
    """The session's folder: the payload's own if there is one, else SESSION in SESSIONS_ROOT; None without a folder."""
    places = [os.path.join(cwd or os.getcwd(), named)] if named else []
    if "SESSION" in environment and "SESSIONS_ROOT" in environment:
        places.append(os.path.join(environment["SESSIONS_ROOT"], environment["SESSION"]))
    return next((p for p in places if os.path.isdir(p)), None)


def session_cwd(folder: str | None, fallback: str) -> str:
    """The project folder that the session's ``cwd`` file names, else ``fallback``."""
    try:
        with open(os.path.join(folder or "", "cwd"), encoding="utf-8") as f:
            return f.read().strip()
    except OSError:
        return fallback


def sessions_root(config_path: str, folder: str = "") -> str:
    """The folder of sessions that a TOML file's [paths] names; relative ones lie in ``folder`` or beside the file."""
    try:
        with open(config_path, "rb") as f:
            named = tomllib.load(f).get("paths", {}).get("sessions_root", "sessions")
    except (OSError, tomllib.TOMLDecodeError, AttributeError):
        named = "sessions"
    return named if os.path.isabs(named) else os.path.join(folder or os.path.dirname(config_path), named)


def status_ops(ops: DataFrame, states: DataFrame) -> DataFrame:
    """The status row for each row request (v, op, session) whose session has a state; others give none."""
    from clearprose.operators.report import status_row

    return status_row(ops.filter("v = 1 and op = 'row'").join(states, "session"))
