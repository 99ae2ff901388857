"""Registered queries of edits, calls, sessions and streams, over the tables' own texts, and the SQL that gives the same rows.

Violations are put beside a table's text, as the driver's texts hold hardly any; most queries
leave only the semicolon rule on, so that SQL can tell places and messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearprose import config as settings
from clearprose import dictionary
from clearprose.config import LintConfig
from clearprose.functions import table
from clearprose.functions.prompt import rule_summary
from clearprose.operators import diff, extract, gate, report, segment, shell
from clearprose.plans.lint import lint, lint_edits
from clearprose.plans.windows import FRAGMENT, WINDOWS, tool_after
from clearprose.queries import _SQL_PLACES, _SQL_SENTENCES, SEEDED, _docs, _forms_sql, _only, _seeded, _sql_lines, _table
from clearprose.session import shared_folder
from clearprose.sources import readers, session_logs
from clearprose.streaming.follow_ups import follow_up_sink, follow_ups
from clearprose.streaming.open_files import open_files_stream
from clearprose.streaming.reply_gate import gate_stream
from clearprose.streaming.snapshots import consumed_snapshots
from clearprose.streaming.state import drained

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEMICOLON = _only("semicolon")
_SAID = "[semicolon]: Do not use a semicolon in prose. Write two sentences."


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Documents whose first line holds something.
_FIRST = "split_part(text, chr(10), 1)"
_SOME = f"(SELECT *, {_FIRST} AS fl FROM documents WHERE trim({_FIRST}, ' ' || chr(9) || chr(13)) <> '')"


def _some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("fl", F.expr("split_part(text, '\n', 1)")).filter("trim(BOTH ' \t\r' FROM fl) <> ''")


# --- extraction and segmentation -------------------------------------------------------------

# Fixed text: comment over two lines, a span, indented code, a fence of tildes, a quote.
_MARKED = "'<!-- ' || fl || chr(10) || fl || ' --> tail' || chr(10) || 'Pre `' || fl || '` post' || chr(10) || '    ' || fl || chr(10) || '~~~' || chr(10) || fl || chr(10) || '~~~~' || chr(10) || '> ' || fl"


@_query(
    f"WITH s AS (SELECT doc_id, fl, strlen(fl) AS n FROM {_SOME}), l AS (SELECT doc_id, unnest(range(1, 9)) AS line_no, unnest([repeat(' ', n + 5), repeat(' ', n + 9), 'Pre ' || repeat(' ', n + 2) || ' post', repeat(' ', n + 4), '   ', repeat(' ', n), '    ', '> ' || fl]) AS text FROM s) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM l"
)
def q_cleared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _some(spark, sf_dir).select("doc_id", "kind", F.expr(_MARKED).alias("text"))
    return extract.prose_lines(docs).select("doc_id", "line_no", "text")


# Fixed text: a quote, a numbered item, a thematic break, a heading, a setext line, a bullet.
_BLOCKS = "'> ' || fl || chr(10) || '1. ' || fl || chr(10) || '- - -' || chr(10) || '## ' || fl || chr(10) || fl || chr(10) || '===' || chr(10) || '* ' || fl || chr(10) || '2) end. of it'"


@_query(f"WITH {_sql_lines(_SOME, '(' + _BLOCKS + ')')}, {_SQL_SENTENCES} SELECT doc_id, sid AS sent_no, line, col, word_count FROM sentences")
def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _some(spark, sf_dir).select("doc_id", "kind", F.expr(_BLOCKS).alias("text"))
    told = segment.sentences(extract.prose_arrays(docs), segment.NO_TEXTS)
    return told.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "line", "col", F.col("word_count").cast("bigint").alias("word_count"))


@_query("SELECT doc_id, CAST(2 AS BIGINT) AS line, CAST(9 AS BIGINT) AS col, 'semicolon' AS rule_id, 'hard' AS severity FROM documents WHERE doc_id % 3 = 0")
def q_lint_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL, beside a table's rows."""
    table.register(spark, SEMICOLON)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring_index("text", "\n", 1), F.lit("\nOne here; two.\n"), "text")).otherwise(F.col("text"))
    docs = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return spark.sql("SELECT d.doc_id, v.line, v.col, v.rule_id, v.severity FROM {docs} d, LATERAL lint(d.text, 'prose-file') v", docs=docs)


# --- reports -----------------------------------------------------------------------------------

_PHRASES = _only("phrasal-verb", "hedging", "marketing", "dictionary-not-approved-word")


def _ordered_forms() -> str:
    values = ", ".join("('{}', '{}', '{}', '{}', {}, {}, {})".format(r[0], r[3].replace("'", "''"), r[4].replace("'", "''"), r[5], {"phrasal-verb": 4, "hedging": 5, "marketing": 6}.get(r[0], 7), r[1], r[2]) for r in dictionary.rows(_PHRASES))
    return f"ordered(rule_id, form, phrase, fix, ro, eo, fo) AS (VALUES {values})"


@_query(
    f"WITH {_sql_lines('documents', SEEDED)}, {_forms_sql(_PHRASES)}, {_SQL_PLACES}, {_ordered_forms()}, d AS (SELECT doc_id, line_no + 1 AS line_no FROM lines WHERE contains(line, 'bogus-rule, hedging')), "
    "v AS (SELECT h.doc_id, h.line_no, h.col, o.* FROM hits h JOIN ordered o ON o.rule_id = h.rule_id AND o.form = h.form AND o.fix = h.suggestion LEFT JOIN d ON d.doc_id = h.doc_id AND d.line_no = h.line_no WHERE d.doc_id IS NULL OR h.rule_id <> 'hedging'), "
    "t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (rule_id NOT IN ('hedging', 'marketing')) AS hard, string_agg('  line ' || line_no || ', column ' || CAST(col AS BIGINT) || ' [' || rule_id || ']: Use an approved word instead of \"' || phrase || '\". Suggested fix: use \"' || fix || '\".', chr(10) ORDER BY line_no, col, ro, eo, fo) AS body FROM v GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN n IS NULL THEN 'doc' || doc_id || ': clean' ELSE 'doc' || doc_id || ': ' || n || ' violation(s), ' || hard || ' hard, ' || (n - hard) || ' soft' || chr(10) || body END AS report, n IS NOT NULL AS failed FROM documents LEFT JOIN t USING (doc_id)"
)
def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(spark, sf_dir).withColumn("label", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return report.text_reports(docs, lint(docs, _PHRASES))


@_query(
    "SELECT doc_id, '{\"file\":\"doc' || doc_id || '\",\"kind\":\"prose-file\",\"total\":' || n || ',\"hard\":' || n || ',\"soft\":0,\"violations\":[' || CASE WHEN n = 1 THEN '{\"rule_id\":\"semicolon\",\"severity\":\"hard\",\"line\":' || (len(string_split(text, chr(10))) + 1) || ',\"column\":9,\"message\":\"Do not use a semicolon in prose. Write two sentences.\"}' ELSE '' END || ']}' AS report "
    "FROM (SELECT doc_id, text, CAST(doc_id % 2 AS BIGINT) AS n FROM documents)"
)
def q_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("label", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("\nAn extra; line."))).otherwise(F.col("text")))
    return report.json_reports(docs, lint(docs, SEMICOLON))


# --- edits -------------------------------------------------------------------------------------

_OLD = "fl || chr(10)"
_TIMES = "(length(text) - length(replace(text, fl || chr(10), ''))) // (length(fl) + 1)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inserted line after the first; every seventh file is missing."""
    docs, old = _some(spark, sf_dir), F.concat("fl", F.lit("\n"))
    content = F.when(F.col("doc_id") % 7 != 3, F.col("text"))
    return docs.select("doc_id", "kind", "text", content.alias("content"), old.alias("old_string"), F.concat(old, F.lit("Inserted; line.\n")).alias("new_string"), F.lit(False).alias("replace_all"))


@_query(f"SELECT doc_id, CAST(2 AS BIGINT) AS line, CAST(9 AS BIGINT) AS col FROM (SELECT doc_id, {_TIMES} AS n FROM {_SOME}) WHERE doc_id % 7 = 3 OR n = 1")
def q_edit_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint_edits(_edits(spark, sf_dir), SEMICOLON).select("doc_id", "line", "col")


@_query(
    f"SELECT doc_id AS call_id, 'Writing rules blocked' || chr(10) || ' docs/d' || doc_id || '.md:' || chr(10) || '- line 2, column 9 {_SAID}' AS reason FROM (SELECT doc_id, {_TIMES} AS n FROM {_SOME}) WHERE doc_id % 2 = 0 OR doc_id % 7 = 3 OR n = 1"
)
def q_block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of changed texts (even ids) and edits, against the files they change."""
    edits = _edits(spark, sf_dir)
    path = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    write = F.col("doc_id") % 2 == 0
    whole = F.concat("new_string", F.substring("text", F.length("old_string") + 1, F.length("text")))
    calls = edits.withColumn("path", path)
    arguments = F.struct(
        F.col("path").alias("file_path"), F.lit(None).cast("string").alias("path"), F.when(write, whole).alias("content"), F.when(~write, F.col("old_string")).alias("old_string"),
        F.when(~write, F.col("new_string")).alias("new_string"), F.lit(False).alias("replace_all"), F.lit(None).cast("string").alias("command"),
    )
    files = calls.filter("content is not null").select("path", "content")
    calls = calls.select(F.col("doc_id").alias("call_id"), F.when(write, "write").otherwise("edit").alias("name"), arguments.alias("arguments"))
    return gate.check_calls(calls, files, SEMICOLON)[0]


# --- calls of a batch, splices, open files --------------------------------------------------------

_FILES = 40
# A file's text, and what each call saw of it before: the same, no line with the violation, or a line that goes.
_KIND = f"doc_id // {_FILES} % 3"


def _calls_on_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, current) of one batch with a call for each document on one of few files."""
    docs = _some(spark, sf_dir)
    path = F.concat(F.lit("d/"), (F.col("doc_id") % _FILES).cast("string"), F.lit(".md"))
    current = docs.filter(F.col("doc_id") < _FILES).select(path.alias("path"), F.concat("fl", F.lit("\nOld line.\nA new; line.\nEnd.")).alias("content"))
    case = F.expr(f"doc_id div {_FILES} % 3")
    seen = docs.withColumn("path", path).join(current, "path")
    prev = F.when(case == 0, F.col("content")).when(case == 1, F.replace("content", F.lit("A new; line.\n"), F.lit(""))).otherwise(F.concat(F.lit("Gone.\n"), "content"))
    return seen.select(F.col("doc_id").alias("call_id"), F.col("doc_id").cast("int").alias("ord"), F.lit(0).alias("nth"), "path", prev.alias("prev")), current


_FOLD_SQL = f"""WITH RECURSIVE c AS (SELECT doc_id, doc_id % {_FILES} AS f, {_KIND} AS k FROM {_SOME} WHERE doc_id % {_FILES} IN (SELECT doc_id FROM {_SOME} WHERE doc_id < {_FILES})),
n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS i FROM c),
r AS (SELECT doc_id, f, k, i, k = 1 AS told, k = 1 AS opened FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.f, n.k, n.i, n.k = 1 OR (n.k = 2 AND r.opened), n.k = 1 OR r.opened FROM r JOIN n ON n.f = r.f AND n.i = r.i + 1)"""
_REPORT_SQL = f"'[simple-english] Post-check of files changed by this command.' || chr(10) || 'Writing-rule violations in d/' || f || '.md:' || chr(10) || '- line 3, column 6 {_SAID}' || chr(10) || '{gate.TO_DO}'"


@_query(f"{_FOLD_SQL} SELECT doc_id AS call_id, {_REPORT_SQL} AS report FROM r WHERE told")
def q_calls_of_a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots, current = _calls_on_files(spark, sf_dir)
    return gate.post_check(snapshots, current, spark.createDataFrame([], "path string, hard bigint"), SEMICOLON)[0]


@_query(f"{_FOLD_SQL} SELECT doc_id AS call_id, CASE WHEN doc_id % 4 = 0 THEN d.lang || ' own' WHEN doc_id % 4 = 1 THEN d.lang || ' beside' ELSE '' END || chr(10) || chr(10) || {_REPORT_SQL} AS text, doc_id % 4 < 2 AS has_code FROM r JOIN documents d USING (doc_id) WHERE told")
def q_spliced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by id, by place, and calls without any."""
    snapshots, current = _calls_on_files(spark, sf_dir)
    some = _docs(spark, sf_dir).filter("doc_id % 4 < 2")
    own = F.col("doc_id") % 4 == 0
    results = some.select(F.when(own, F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("call_id"), F.col("doc_id").cast("int").alias("place"), F.concat("lang", F.when(own, " own").otherwise(" beside")).alias("text"), F.lit(0).alias("code"))
    calls = _docs(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.col("doc_id").cast("int").alias("ord"))
    told = tool_after(snapshots, current, spark.createDataFrame([], "path string, hard bigint"), results, SEMICOLON, calls)[0]
    return told.select("call_id", "text", F.col("code").isNotNull().alias("has_code"))


def _in_parts(rows: DataFrame, key: str, parts: int, name: str) -> tuple[str, list[DataFrame]]:
    """A folder to stream from, and what to append to it one after another."""
    return shared_folder(rows.sparkSession, name), [rows.filter(F.col(key) % parts == i) for i in range(parts)]


def _streamed(rows: DataFrame, key: str, transform, parts: int = 3) -> DataFrame:
    """The output of a stream whose input comes in parts; the stream is stopped and goes on from its checkpoint between them."""
    spark = rows.sparkSession
    source, some = _in_parts(rows, key, parts, "input")
    sink = shared_folder(spark, "stream")
    for part in some:
        part.write.mode("append").parquet(source)
        out = drained(transform(spark.readStream.schema(rows.schema).parquet(source)), sink)
    return out


@_query(
    f"WITH RECURSIVE e AS (SELECT doc_id, source AS session, doc_id % {_FILES} AS f, doc_id // {_FILES} AS v, doc_id % 11 = 0 AS gone, doc_id % 3 = 0 AS fresh, doc_id % 5 < 2 AS old, row_number() OVER (PARTITION BY source, doc_id % {_FILES} ORDER BY (doc_id // {_FILES}) % 3, doc_id) AS i FROM documents WHERE source IS NOT NULL), "
    "s AS (SELECT *, CASE WHEN gone THEN 0 ELSE CAST(fresh AS INT) END AS hard FROM e WHERE i = 1 "
    "UNION ALL SELECT e.*, CASE WHEN e.gone THEN 0 WHEN NOT (e.fresh OR e.doc_id % 7 = 0) THEN -s.hard2 ELSE CAST(e.fresh AS INT) + CASE WHEN s.hard2 > 0 THEN CAST(e.old AS INT) ELSE 0 END END FROM (SELECT *, abs(hard) AS hard2 FROM s) s JOIN e ON e.session = s.session AND e.f = s.f AND e.i = s.i + 1) "
    "SELECT session, CAST(doc_id AS VARCHAR) AS call_id, 'd/' || f || '.md' AS path, CAST(hard AS BIGINT) AS hard FROM s WHERE gone OR fresh OR doc_id % 7 = 0"
)
def q_open_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of files by session over three micro-batches, each with several calls on one file."""
    docs = _docs(spark, sf_dir).filter("source is not null")
    head = F.when(F.col("doc_id") % 5 < 2, "Old; line.\n").otherwise("Fine.\n")
    text = F.coalesce("text", F.lit(""))
    fresh, other = F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 0
    content = F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(head, F.when(other, "Gone soon.\n").otherwise(""), text, F.when(fresh, "\nAn extra; line.").otherwise("")))
    rows = docs.select(
        F.col("source").alias("session"), F.expr(f"(doc_id div {_FILES}) % 3").alias("batch"), F.col("doc_id").cast("int").alias("ord"), F.col("doc_id").cast("string").alias("call_id"), F.lit(0).alias("nth"),
        F.concat(F.lit("d/"), (F.col("doc_id") % _FILES).cast("string"), F.lit(".md")).alias("path"), F.concat(head, text).alias("prev"), content.alias("content"),
    )
    told = _streamed(rows, "batch", lambda s: open_files_stream(s, SEMICOLON))
    return told.select("session", "call_id", "path", "hard")


@_query(
    "SELECT CAST(doc_id % 50 AS VARCHAR) AS session, CAST(doc_id AS VARCHAR) AS call_id, 'd/' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS prev, sha256(coalesce(text, '') || '!') AS content FROM documents WHERE doc_id % 3 <> 0"
)
def q_snapshots_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of calls, read by their ends; calls that never end and second ends give nothing."""
    docs = _docs(spark, sf_dir)
    shared = [(F.col("doc_id") % 50).cast("string").alias("session"), F.lit(0).alias("ord"), F.col("doc_id").cast("string").alias("call_id"), F.lit(0).alias("nth"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")]
    digest, none, part = lambda x: F.sha2(x, 256), F.lit(None).cast("string"), F.expr("(doc_id div 50) % 3").alias("part")
    # batches of a session follow one another within and over the parts
    batch = F.expr("((doc_id div 50) % 3) * 1000000000 + doc_id").alias("batch")
    text = F.coalesce("text", F.lit(""))
    before = docs.select(*shared, part, batch, F.lit(0).alias("at"), digest(text).alias("prev"), none.alias("content"))
    after = docs.filter("doc_id % 3 <> 0").select(*shared, part, batch, F.lit(1).alias("at"), none.alias("prev"), digest(F.concat(text, F.lit("!"))).alias("content"))
    again = docs.filter("doc_id % 3 = 1").select(*shared, part, batch, F.lit(2).alias("at"), none.alias("prev"), digest(text).alias("content"))
    told = _streamed(before.unionByName(after).unionByName(again), "part", consumed_snapshots)
    return told.select("session", "call_id", "path", "prev", "content")


# --- replies -----------------------------------------------------------------------------------

_BAD = "(conv_id + turn) % 3 < 2"
_GATE_SQL = (
    f"WITH RECURSIVE r AS (SELECT conv_id, turn, text, CASE WHEN {_BAD} THEN 1 ELSE 0 END AS hard, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant' AND trim(text) <> ''), "
    "g AS (SELECT conv_id, turn, text, i, hard, hard = 1 AS gated, hard AS c FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.text, r.i, r.hard, r.hard = 1 AND g.c < 3, CASE WHEN r.hard = 0 THEN 0 WHEN g.c < 3 THEN g.c + 1 ELSE g.c END FROM r JOIN g ON r.conv_id = g.conv_id AND r.i = g.i + 1)"
)


def _told_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''")
    content = F.when(F.expr(_BAD), F.concat("text", F.lit("\nOne; two "), F.col("turn").cast("string"), F.lit("."))).otherwise(F.col("text"))
    return some.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), content.alias("content"))


@_query(f"{_GATE_SQL} SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, CAST(hard AS BIGINT) AS hard, gated, CAST(c AS INT) AS gate_count FROM g")
def q_reply_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of replies over a stream in two parts: early turns, then the others."""
    replies = _told_replies(spark, sf_dir)
    parted = replies.withColumn("part", F.when(F.col("seq") < 3, 0).otherwise(1))
    told = _streamed(parted, "part", lambda s: gate_stream(gate.linted_replies(s.select("session", "seq", "content"), SEMICOLON)), parts=2)
    return told.select("session", "seq", "hard", "gated", "gate_count")


@_query(
    f"{_GATE_SQL} SELECT CAST(conv_id AS VARCHAR) AS session, 'user_message' AS type, 'follow' AS queue, 'Your last reply had 1 hard writing-rule violation(s). Re-send the complete reply, in full, with every flagged issue below fixed. Do not reply with only the changed lines. Keep the same meaning and content; change only what the flagged issues require. Do not re-run, re-verify, or redo the work. Do not answer your own open questions as if the user replied.' || chr(10) || chr(10) || 'Hard violations:' || chr(10) || "
    f"' reply:' || chr(10) || '- line ' || (len(string_split(text, chr(10))) + 1) || ', column 4 {_SAID}' AS content FROM g WHERE gated"
)
def q_follow_up_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer of follow-ups leaves after a stream of replies."""
    source, path = shared_folder(spark, "replies"), shared_folder(spark, "follow-ups")
    replies = _told_replies(spark, sf_dir)
    replies.write.parquet(source)
    stream = spark.readStream.schema(replies.schema).parquet(source)
    follow_up_sink(gate_stream(gate.linted_replies(stream, SEMICOLON)), path, f"{path}-checkpoint").awaitTermination()
    return follow_ups(spark, path).select("session", "type", "queue", "content")


@_query(
    "SELECT CAST(conv_id AS VARCHAR) AS session, CASE WHEN conv_id % 10 = 3 THEN 'none' WHEN bool_or(role = 'assistant' AND trim(text) <> '') THEN 'event' ELSE 'none' END AS outcome, CASE WHEN conv_id % 10 <> 3 THEN arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') END AS content FROM conversations GROUP BY conv_id"
)
def q_session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last replies of logs written from conversations; sequence numbers run against the order of the lines, some sessions never reply."""
    root = shared_folder(spark, "sessions")
    turns = _table(spark, sf_dir, "conversations")
    role = F.when((F.col("conv_id") % 10 == 3) & (F.col("role") == "assistant"), "tool").otherwise(F.col("role"))
    events = turns.select(F.col("conv_id").alias("session"), F.lit(1).alias("v"), F.concat(role, F.lit("_message")).alias("type"), F.lit("2024-01-01T00:00:00Z").alias("ts"), F.when(F.col("turn") % 2 == 0, 1000 - F.col("turn")).alias("seq"), F.col("text").alias("content"), F.col("turn"))
    session_logs.write_logs(events, root)
    told = session_logs.last_reply_outcomes(session_logs.session_logs(spark, root))
    return told.select("session", "outcome", "content")


@_query(f"SELECT conv_id AS session, turn AS seq, CAST(2 AS INT) AS n, sha256('{rule_summary(LintConfig()).replace(chr(39), chr(39) * 2)}') AS summary_sha256, text AS first FROM conversations WHERE text IS NOT NULL")
def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of turns whose old summary goes and whose new one comes last."""
    turns = _table(spark, sf_dir, "conversations").filter("text is not null")
    prompts = turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.array(F.array(F.lit(FRAGMENT), F.lit("old")), F.array(F.lit("turn"), F.col("text"))).alias("input"))
    told = WINDOWS["model.before"](WINDOWS["model.before"](prompts, LintConfig()), LintConfig())
    return told.select("session", "seq", F.size("input").alias("n"), F.sha2(F.col("input")[1][1], 256).alias("summary_sha256"), F.col("input")[0][1].alias("first"))


_FNV_SQL = (
    "list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(0, strlen(text)), lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS UHUGEINT))), "
    "lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"
)


@_query(f"SELECT conv_id AS session, turn AS seq, lpad(lower(hex(CAST({_FNV_SQL} AS UBIGINT))), 16, '0') AS identity FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def q_reply_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
    told = gate.with_identity(some.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("content")))
    return told.select("session", "seq", "identity")


@_query("SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_changed FROM (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY lang")
def q_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of texts whose middle line is doubled in front of another (even ids), or are as they were."""
    docs = _docs(spark, sf_dir).filter("text is not null and text <> ''")
    lines = F.split("text", "\n")
    half = F.floor(F.size("l") / 2).cast("int")
    new = F.when(F.col("doc_id") % 2 == 0, F.concat(F.slice("l", F.lit(1), half), F.array(F.concat(F.lit("only here "), F.col("doc_id").cast("string"))), F.slice("l", half + 1, F.size("l")))).otherwise(F.col("l"))
    told = docs.withColumn("l", lines).withColumn("new", new)
    changed = diff.changed_column(F.col("l"), F.col("new"))
    return told.select("lang", F.size(changed).alias("n")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_changed"))


# --- payloads, kinds, paths, states -----------------------------------------------------------------


@_query(
    "SELECT 's' || (doc_id % 9) AS session, CAST(o AS INT) AS ord, CASE o WHEN 0 THEN 'w' || doc_id ELSE '' END AS call_id, CASE o WHEN 0 THEN 'write' ELSE 'bash' END AS name, CASE o WHEN 0 THEN sha256(coalesce(text, '')) ELSE sha256('ls d' || doc_id) END AS digest FROM documents, (VALUES (0), (1)) v(o) WHERE doc_id % 5 <> 0"
)
def q_payload_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of JSON payloads; a fifth of them is cut off."""
    docs = _docs(spark, sf_dir)
    calls = F.array(
        F.struct(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("id"), F.lit("write").alias("name"), F.struct(F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("string").alias("command")).alias("arguments")),
        F.struct(F.lit(None).cast("string").alias("id"), F.lit("bash").alias("name"), F.struct(F.lit(None).cast("string").alias("content"), F.concat(F.lit("ls d"), F.col("doc_id").cast("string")).alias("command")).alias("arguments")),
    )
    raw = F.to_json(F.struct(F.concat(F.lit("s"), (F.col("doc_id") % 9).cast("string")).alias("session"), calls.alias("calls"), F.lit(7).alias("unknown")))
    told = readers.calls_of(readers.payloads(docs.select(F.when(F.col("doc_id") % 5 == 0, F.left(raw, F.lit(20))).otherwise(raw).alias("value"))))
    return told.select("session", F.col("ord").cast("int").alias("ord"), "call_id", "name", F.sha2(F.coalesce("arguments.content", "arguments.command"), 256).alias("digest"))


_TOML = """
exempt_block_quotes = true
[rules]
semicolon = "soft"
contraction = "loud"
sentence-length = "off"
paragraph-length = "off"
phrasal-verb = "off"
hedging = "off"
marketing = "off"
dictionary-not-approved-word = "off"
no-such-rule = "hard"
"""


@_query("SELECT doc_id, line, CAST(6 AS BIGINT) AS col, 'semicolon' AS rule_id, 'soft' AS severity FROM documents, (VALUES (CAST(4 AS BIGINT)), (CAST(6 AS BIGINT))) v(line)")
def q_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TOML configuration: exempt quotes, a rule made soft, rules off by any other word, and directives that name rules without a check."""
    head = "> Quoted; don't look.\n// ste-disable-next-line verb-passive, semicolon\nNever; said.\nThree; four.\n# ste-disable-next-line: contraction\nFive'; six.\n"
    docs = _docs(spark, sf_dir).select("doc_id", "kind", F.concat(F.lit(head), F.coalesce("text", F.lit(""))).alias("text"))
    return lint(docs, settings.from_toml(_TOML)).select("doc_id", "line", "col", "rule_id", "severity")


_SOURCE = "'// ' || fl || chr(10) || '/// ' || fl || chr(10) || 'x = \"a // b\"; // ' || fl || chr(10) || '/* ' || fl || chr(10) || '  ' || fl || chr(10) || 'end */ y // no' || chr(10) || '/* one */ z' || chr(10) || '//' || chr(10) || 'plain'"


@_query(f"WITH s AS (SELECT doc_id, trim(fl, ' ' || chr(9) || chr(13)) AS t, regexp_replace(fl, '^\\s+', '') AS l FROM {_SOME}) SELECT doc_id, CAST(unnest(range(1, 8)) AS BIGINT) AS line_no, unnest([t, '/ ' || t, t, t, l, 'end */', 'one']) AS text FROM s")
def q_slash_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _some(spark, sf_dir).select("doc_id", F.lit("slash-source").alias("kind"), F.expr(_SOURCE).alias("text"))
    return extract.prose_lines(docs).select("doc_id", "line_no", "text")


@_query(f"WITH s AS (SELECT doc_id, trim(fl, ' ' || chr(9) || chr(13)) AS t FROM {_SOME}) SELECT doc_id, CAST(unnest([1, 2]) AS BIGINT) AS line_no, unnest([t, '# ' || t]) AS text FROM s")
def q_hash_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "'#!/bin/sh' || chr(10) || '# ' || fl || chr(10) || 'x = 1 # ' || fl || chr(10) || '   ## ' || fl || chr(10) || '#'"
    docs = _some(spark, sf_dir).select("doc_id", F.lit("hash-source").alias("kind"), F.expr(text).alias("text"))
    return extract.prose_lines(docs).select("doc_id", "line_no", "text")


@_query(
    "SELECT doc_id AS call_id, CAST(o AS INT) AS nth, CASE o WHEN 0 THEN '/h.md' WHEN 1 THEN f || '/d/' || doc_id || '.md' WHEN 2 THEN '/home/me/x.txt' ELSE '/abs/' || doc_id || '.rs' END AS path, CASE WHEN o = 1 AND doc_id % 2 = 0 THEN sha256(text) END AS prev FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '/p' ELSE '/w' END AS f FROM documents WHERE text IS NOT NULL), (VALUES (0), (1), (2), (4)) v(o)"
)
def q_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that commands mention, in order, below the session's own folder or the process's; data files are left out."""
    docs = _docs(spark, sf_dir).filter("text is not null")
    name = F.col("doc_id").cast("string")
    command = F.concat(F.lit("cat ~/h.md d/"), name, F.lit(".md ~x.txt > out.css && cp d/"), name, F.lit(".md /abs/"), name, F.lit(".rs"))
    commands = docs.select(F.col("doc_id").alias("call_id"), command.alias("command"), F.lit("/w/").alias("cwd"), F.when(F.col("doc_id") % 2 == 0, " /p\n").alias("session_cwd"))
    files = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("/p/d/"), name, F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return shell.snapshots(commands, files, "/home/me").select("call_id", "nth", "path", F.sha2("prev", 256).alias("prev"))


@_query(
    "SELECT conv_id AS session, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS hard, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS soft, CAST(1 AS INT) AS version, CASE WHEN conv_id % 3 > 0 THEN ' Writing-rule reply: ' || count(*) FILTER (role = 'assistant') || ' hard, ' || count(*) FILTER (role = 'user') || ' soft ' END AS row_text FROM conversations GROUP BY conv_id"
)
def q_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply states written and read again, and the rows that requests for some of them get."""
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    states = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(n("assistant").alias("hard"), n("user").alias("soft"))
    path = shared_folder(spark, "states")
    readers.write_state(states, path, "reply")
    kept = readers.read_state(spark, path, "reply").withColumn("session", F.col("session").cast("bigint"))
    ops = kept.select("session", F.when(F.col("session") % 3 == 0, 2).otherwise(1).alias("v"), F.lit("row").alias("op"))
    rows = readers.status_ops(ops, kept.select("session", "hard", "soft")).select("session", F.col("text").alias("row_text"))
    return kept.select("session", "hard", "soft", "version").join(rows, "session", "left")
