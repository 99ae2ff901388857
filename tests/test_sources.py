"""Session logs, states and paths."""

import gzip
import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from clearprose.operators import shell
from clearprose.sources import readers, session_logs
from clearprose.streaming.state import drained


def event(kind, content, **more):
    return json.dumps({"v": 1, "type": kind, "ts": "t", "content": content, **more})


def logs(root):
    said = {
        "plain": [event("user_message", "hi"), event("assistant_message", "first", seq=9), event("assistant_message", "last", seq=2), event("assistant_message", " \n"), "no json", event("user_message", "end")],
        "none": [event("user_message", "hi"), event("assistant_message", "")],
        "gz": [event("assistant_message", "zipped")],
        "zst": [event("assistant_message", "packed é")],
    }
    for name, lines in said.items():
        os.makedirs(f"{root}/{name}")
        raw = ("\n".join(lines) + "\n").encode()
        if name == "gz":
            with gzip.open(f"{root}/{name}/events.jsonl.gz", "wb") as f:
                f.write(raw)
        elif name == "zst":
            with pa.output_stream(f"{root}/{name}/events.jsonl.zst", compression="zstd") as f:
                f.write(raw)
        else:
            with open(f"{root}/{name}/events.jsonl", "wb") as f:
                f.write(raw)
    os.makedirs(f"{root}/absent")
    for name, raw in (("torn.gz", b"\x1f\x8bnot a gzip file"), ("bytes", b'{"type":"assistant_message","content":"\xff"}\n')):
        folder = f"{root}/bad-{name.split('.')[0]}"
        os.makedirs(folder)
        with open(f"{folder}/events.jsonl{'.gz' if 'gz' in name else ''}", "wb") as f:
            f.write(raw)


def test_last_replies_and_why_there_are_none(spark, tmp_path):
    logs(str(tmp_path))
    got = {r.session: (r.outcome, r.content) for r in session_logs.last_reply_outcomes(session_logs.session_logs(spark, str(tmp_path))).collect()}
    assert got == {
        "plain": ("event", "last"), "none": ("none", None), "gz": ("event", "zipped"), "zst": ("event", "packed é"),
        "absent": ("absent", None), "bad-torn": ("unreadable", None), "bad-bytes": ("unreadable", None),
    }


def test_many_sessions_are_read_by_few_tasks(spark, tmp_path):
    for i in range(150):
        os.makedirs(tmp_path / f"s{i}")
        (tmp_path / f"s{i}" / "events.jsonl").write_text(event("assistant_message", f"said {i}", seq=True if i else 1 << 70) + "\n")
    logs_read = session_logs.session_logs(spark, str(tmp_path))
    assert logs_read.rdd.getNumPartitions() == session_logs.TASKS
    assert sorted((r.session, r.outcome, r.content) for r in session_logs.last_reply_outcomes(logs_read).collect()) == sorted((f"s{i}", "event", f"said {i}") for i in range(150))
    assert session_logs.session_logs(spark, str(tmp_path / "nowhere")).collect() == []


def test_logs_are_tailed(spark, tmp_path):
    root, sink = str(tmp_path / "root"), str(tmp_path / "sink")
    os.makedirs(f"{root}/s")
    log = f"{root}/s/events.jsonl"
    seen = lambda: [(r.place, r.content) for r in drained(session_logs.session_log_stream(spark, root), sink).orderBy("place").collect()]
    with open(log, "w") as f:
        f.write(event("user_message", "one") + "\n" + event("assistant_message", "tw")[:20])  # a line that hasn't ended
    first = seen()
    assert [c for _, c in first] == ["one"]
    with open(log, "a") as f:
        f.write(event("assistant_message", "tw")[20:] + "\n" + event("assistant_message", "three") + "\n")
    assert [c for _, c in seen()] == ["one", "tw", "three"]
    assert [p for p, _ in seen()] == [0, len(event("user_message", "one")) + 1, len(event("user_message", "one")) + len(event("assistant_message", "tw")) + 2]


def test_states_have_schemas(spark, tmp_path):
    path = str(tmp_path / "state")
    readers.write_state(spark.createDataFrame([("s", 2, ["x"])], "session string, hard bigint, gated_replies array<string>"), path, "reply")
    (row,) = readers.read_state(spark, path, "reply").collect()
    assert (row.session, row.version, row.hard, row.soft, row.gated_replies) == ("s", 1, 2, None, ["x"])
    with open(f"{path}/part-extra.json", "w") as f:
        f.write("torn {\n")
    assert readers.read_state(spark, path, "reply").count() == 1


def test_folders(spark, tmp_path):
    os.makedirs(tmp_path / "root" / "name")
    (tmp_path / "root" / "name" / "cwd").write_text(" /work/here\n")
    root = {"SESSION": "name", "SESSIONS_ROOT": str(tmp_path / "root")}
    assert readers.session_folder(str(tmp_path / "root"), {}) == str(tmp_path / "root")
    assert readers.session_folder("root", {}, str(tmp_path)) == str(tmp_path / "root")
    assert readers.session_folder("nowhere", root, str(tmp_path)) == str(tmp_path / "root" / "name")
    assert readers.session_folder(None, {"SESSION": "name"}) is None
    assert readers.session_cwd(str(tmp_path / "root" / "name"), "/x") == "/work/here" and readers.session_cwd(None, "/x") == "/x"
    rows = spark.createDataFrame([("a.md", None), ("a.md", "/own"), ("/a.md", "/own"), ("~/a.md", None), ("~a.md", None)], "p string, s string")
    got = [r.x for r in rows.select(shell.resolved_path(F.col("p"), F.lit("/w/"), "/home", F.col("s")).alias("x")).collect()]
    assert got == ["/w/a.md", "/own/a.md", "/a.md", "/a.md", "/home/a.md"]
