"""Registered queries of the lint engine and the SQL that gives the same rows.

The driver's documents hold few rule hits, so most queries run on a seeded view: a
template chosen by doc_id stands before each text. Templates are one CASE string that
Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearprose import dictionary
from clearprose.config import LintConfig, PhraseEntry
from clearprose.operators import diff, extract, gate, report, rules, segment, shell
from clearprose.operators.classify import path_kind
from clearprose.plans.lint import lint, lint_writes, long_sentences_by_language
from clearprose.session import ready
from clearprose.sources import readers

_NL = "' || chr(10) || '"
TEMPLATES = (
    "Please note that we kick off the robust job. Don''t stop; we''ll go on.",
    f"// ste-disable-next-line semicolon{_NL}One; two.{_NL}Prior to this, it''s able to begin.",
    f"// ste-disable-next-line bogus-rule, hedging{_NL}As mentioned, they''re powerful and seamless.",
    f"One. Two. Three. Four. Five. Six. Seven.{_NL}",
    f"- first item{_NL}- second item{_NL}# Heading text{_NL}Then run e2e.sh now. In order to carry out the plan we utilize the ledger.",
    f"```sh{_NL}echo one; echo two{_NL}```{_NL}Three; four.",
    f"| a | b |{_NL}| --- | --- |{_NL}| c; d | e |{_NL}{_NL}Who''s there? Subsequent to that, numerous users make use of it.",
)
_CASE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES)) + " ELSE '' END"
#: SQL of the seeded text; a template of its own line, then the document.
SEEDED = f"({_CASE} || chr(10) || text)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(_table(spark, sf_dir, "documents")).select("doc_id", F.lit("prose-file").alias("kind"), "text", "lang", "source")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", F.expr(SEEDED))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prose_lines(_seeded(spark, sf_dir))


def _only(*on: str) -> LintConfig:
    from clearprose.config import REGISTERED

    return LintConfig(rules={r: "off" for r in REGISTERED if r not in on})


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Lines of a text column as rows, prose blocks cleared as the templates need it: fences
# (by parity of fence lines), the one table form, and deep indents.
def _sql_lines(source: str, text: str = "text") -> str:
    return f"""
raw AS (SELECT doc_id, string_split(regexp_replace({text}, '\\n$', ''), chr(10)) AS l FROM {source} WHERE {text} <> ''),
numbered AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM raw),
fenced AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS f,
  regexp_matches(line, '^[|: -]*-[|: -]*$') AND contains(coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), ''), '|') AS delim,
  contains(line, '|') AS bar FROM numbered),
islands AS (SELECT *, sum(CASE WHEN bar AND NOT delim THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS isl,
  coalesce(lead(delim) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS head FROM fenced),
tabled AS (SELECT *, bool_or(delim) OVER (PARTITION BY doc_id, isl) AS in_table FROM islands),
lines AS (SELECT doc_id, line_no, CASE WHEN starts_with(line, '```') OR f % 2 = 1 OR delim OR head OR (bar AND in_table) THEN repeat(' ', strlen(line)) ELSE line END AS line FROM tabled)"""


# Sentences of prose lines: the same islands, without the place that an empty marker lends.
_SQL_SENTENCES = r"""
blocks AS (SELECT doc_id, line_no, line,
  CASE WHEN regexp_matches(line, '^\s*$') THEN 'B'
       WHEN regexp_matches(line, '^\s{0,3}((-\s*){3,}|(_\s*){3,}|(\*\s*){3,}|(=\s*){3,})$') THEN 'T'
       WHEN regexp_matches(line, '^\s{0,3}#{1,6}([ \t]|$)') THEN 'S'
       WHEN regexp_matches(line, '^\s{0,3}([-*+][ \t]|[0-9]{1,9}[.)]([ \t]|$))') THEN 'I' ELSE 'N' END AS block FROM lines),
marked AS (SELECT *, CASE block WHEN 'S' THEN regexp_extract(line, '^(\s{0,3}#{1,6}([ \t]|$))', 1)
  WHEN 'I' THEN regexp_extract(line, '^(\s{0,3}([-*+][ \t]|[0-9]{1,9}[.)]([ \t]|$)))', 1)
  WHEN 'N' THEN regexp_extract(line, '^(\s{0,3}>+[ \t]?)', 1) ELSE '' END AS marker,
  sum(CASE WHEN block <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS breaks FROM blocks),
cut AS (SELECT doc_id, line_no, block, breaks, marker, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    substr(line, length(marker) + 1), '([0-9])\.', '\1' || chr(1), 'g'), '([A-Za-z0-9_])\.([A-Za-z0-9_])', '\1' || chr(1) || '\2', 'g'),
    '([A-Za-z0-9_])\.([A-Za-z0-9_])', '\1' || chr(1) || '\2', 'g'), '([.!?。！？]+["”»›)\]}]*)', '\1' || chr(2), 'g'), chr(2)) AS p
  FROM marked WHERE block NOT IN ('B', 'T')),
pieces AS (SELECT doc_id, line_no, block, breaks, marker, len(p) AS n, unnest(range(1, len(p) + 1)) AS ord, unnest(p) AS piece FROM cut),
told AS (SELECT *, strlen(marker) + coalesce(sum(strlen(piece)) OVER (PARTITION BY doc_id, line_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_at,
  ord < n AS ended FROM pieces),
solid AS (SELECT *, trim(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS t, strlen(piece) - strlen(regexp_replace(piece, '^\s+', '')) AS skip FROM told WHERE NOT regexp_matches(piece, '^\s*$')),
lagged AS (SELECT *, lag(ended) OVER w AS pe, lag(line_no) OVER w AS pl, lag(breaks) OVER w AS pb, lag(block) OVER w AS pk FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, ord)),
grouped AS (SELECT *, coalesce(pl <> line_no, true) AS opens,
  sum(CASE WHEN pe IS NULL OR pe OR (pl <> line_no AND (pb <> breaks OR pk = 'S')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, ord) AS sid FROM lagged),
placed AS (SELECT *, byte_at + 1 + CASE WHEN opens OR NOT ended THEN skip ELSE 0 END AS col FROM grouped),
sentences AS (SELECT doc_id, CAST(sid AS BIGINT) AS sid, CAST(sum(len(regexp_extract_all(t, '\S+'))) AS BIGINT) AS word_count,
  CAST(coalesce(arg_max(line_no, line_no * 100000 + ord) FILTER (NOT ended), arg_min(line_no, line_no * 100000 + ord)) AS BIGINT) AS line,
  CAST(coalesce(arg_max(col, line_no * 100000 + ord) FILTER (NOT ended), arg_min(col, line_no * 100000 + ord)) AS BIGINT) AS col
  FROM placed GROUP BY doc_id, sid)"""


@_query(f"WITH {_sql_lines('documents')}, {_SQL_SENTENCES} SELECT lang, count(*) AS n_sentences, count(*) FILTER (word_count > 25) AS n_long, max(word_count) AS max_words FROM sentences JOIN documents USING (doc_id) GROUP BY lang")
def q_sentence_length_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_sentences_by_language(_docs(spark, sf_dir))


@_query(f"WITH {_sql_lines('documents', SEEDED)}, {_SQL_SENTENCES} SELECT doc_id, sid AS sent_no, line, col, word_count FROM sentences")
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(extract.prose_arrays(_seeded(spark, sf_dir).select("doc_id", "kind", "text")), segment.NO_TEXTS).select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "line", "col", F.col("word_count").cast("bigint").alias("word_count"))


@_query(f"WITH {_sql_lines('documents', SEEDED)}, {_SQL_SENTENCES} SELECT doc_id, line, col FROM sentences WHERE word_count > 25")
def q_sentence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint(_seeded(spark, sf_dir), _only("sentence-length")).select("doc_id", "line", "col")


_SQL_PARAGRAPHS = """
flagged AS (SELECT *, lag(block) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM blocks),
paras AS (SELECT doc_id, line_no, block, sum(CASE WHEN before IS NULL THEN 0 WHEN before = 'B' OR block IN ('T', 'S', 'I') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM flagged),
owned AS (SELECT line AS line_no, doc_id, count(*) AS n FROM sentences GROUP BY ALL),
paragraphs AS (SELECT doc_id, para, min(line_no) AS line, CAST(sum(n) AS BIGINT) AS n_sentences FROM paras LEFT JOIN owned USING (doc_id, line_no) WHERE block <> 'B' GROUP BY doc_id, para)"""


@_query(f"WITH {_sql_lines('documents', SEEDED)}, {_SQL_SENTENCES}, {_SQL_PARAGRAPHS} SELECT doc_id, line, n_sentences FROM paragraphs WHERE n_sentences > 6")
def q_paragraph_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.paragraphs(extract.prose_arrays(_seeded(spark, sf_dir).select("doc_id", "kind", "text"))).filter("n_sentences > 6")
    return found.select("doc_id", "line", F.col("n_sentences").cast("bigint").alias("n_sentences"))


@_query(f"WITH {_sql_lines('documents', SEEDED)} SELECT doc_id, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, count(*) FILTER (regexp_matches(line, '^\\s*$')) AS n_blank FROM lines GROUP BY doc_id")
def q_prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"), F.count(F.when(F.col("text").rlike(r"^\s*$"), 1)).alias("n_blank"))


_PATHS = ("README.md", "src/main.rs", "a/run.py", "config.json", "data.csv.gz", "LICENSE.MIT", "Makefile", "a.b/Makefile", "docs/COPYING", "x/y.HTML", "rs", "db", "web/app.tsx", "ci.yml")
_PATH_SQL = "CASE page_id % 15 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " ELSE url END"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _kind_sql(path: str) -> str:
    from clearprose.operators.classify import HASH, SKIP, SLASH

    base, ext = f"lower(string_split({path}, '/')[-1])", f"lower(string_split({path}, '.')[-1])"
    return (
        f"CASE WHEN {base} = 'license' OR starts_with({base}, 'license.') OR starts_with({base}, 'copying') OR {ext} IN {_in(SKIP)} THEN 'skip' "
        f"WHEN {ext} IN {_in(SLASH)} THEN 'slash-source' WHEN {ext} IN {_in(HASH)} THEN 'hash-source' ELSE 'prose-file' END"
    )


@_query(f"SELECT kind, count(*) AS n, min(path) AS first_path FROM (SELECT {_PATH_SQL} AS path, {_kind_sql(_PATH_SQL)} AS kind FROM pages) GROUP BY kind")
def q_classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "pages").select(F.expr(_PATH_SQL).alias("path")).withColumn("kind", path_kind(F.col("path")))
    return told.groupBy("kind").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def _line_hits(spark: SparkSession, sf_dir: str, *on: str) -> DataFrame:
    return rules.line_violations(_seeded(spark, sf_dir), _only(*on))


@_query(f"WITH {_sql_lines('documents', SEEDED)}, p AS (SELECT doc_id, line_no, string_split(line, ';') AS p FROM lines WHERE contains(line, ';')), q AS (SELECT doc_id, line_no, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM p), "
        "r AS (SELECT *, sum(strlen(x) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS col FROM q) SELECT doc_id, line_no AS line, CAST(col AS BIGINT) AS col FROM r WHERE i < n")  # fmt: skip
def q_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_hits(spark, sf_dir, "semicolon").select("doc_id", "line", "col")


@_query("SELECT page_id AS doc_id, CAST(length(html) - length(replace(html, ';', '')) AS BIGINT) AS n FROM pages WHERE contains(html, ';')")
def q_page_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("commit-message").alias("kind"), F.col("html").alias("text"))
    return lint(pages, _only("semicolon")).groupBy("doc_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_sql_lines('documents', SEEDED)}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+[''’](t|re|ve|ll|d|m)\\b')) AS found FROM lines UNION ALL "
        "SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\\b(it|he|she|that|what|who|there|here|let|one|where|how)[''’]s\\b')) FROM lines) SELECT doc_id, line_no AS line, count(*) AS n, min(found) AS first_found FROM m GROUP BY ALL")  # fmt: skip
def q_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _line_hits(spark, sf_dir, "contraction").withColumn("found", F.regexp_extract("message", 'Found "(.*)"', 1))
    return hits.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("found").alias("first_found"))


def _forms_sql(config: LintConfig) -> str:
    values = ", ".join("('{}', '{}', '{}')".format(r[0], r[3].replace("'", "''"), r[5]) for r in dictionary.rows(config))
    return f"forms(rule_id, form, suggestion) AS (VALUES {values})"


_SQL_PLACES = (
    "seen AS (SELECT doc_id, line_no, lower(line) AS low, rule_id, form, suggestion FROM lines, forms WHERE contains(lower(line), form)), "
    "parts AS (SELECT *, string_split(low, form) AS p FROM seen), each AS (SELECT *, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM parts), "
    "ends AS (SELECT *, sum(length(x) + CASE WHEN i > 1 THEN length(form) ELSE 0 END) OVER (PARTITION BY doc_id, line_no, rule_id, form ORDER BY i) AS e FROM each), "
    "hits AS (SELECT doc_id, line_no, rule_id, form, suggestion, strlen(substr(low, 1, CAST(e AS INT))) + 1 AS col FROM ends WHERE i < n AND NOT regexp_matches(CASE WHEN e > 0 THEN substr(low, CAST(e AS INT), 1) ELSE '' END, '[\\p{L}\\p{N}]') "
    "AND NOT regexp_matches(substr(low, CAST(e AS INT) + length(form) + 1, 1), '[\\p{L}\\p{N}]'))"
)


def _phrase_query(name: str, config: LintConfig) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.line_violations(_seeded(spark, sf_dir), config).filter(F.col("suggestions").isNotNull())
        return found.select("doc_id", "rule_id", F.regexp_extract("message", '"(.*)"', 1).alias("form"), F.get("suggestions", F.lit(0)).alias("suggestion"), "line", "col")

    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {_sql_lines('documents', SEEDED)}, {_forms_sql(config)}, {_SQL_PLACES} SELECT doc_id, rule_id, form, suggestion, line_no AS line, CAST(col AS BIGINT) AS col FROM hits"


_phrase_query("q_phrasal_verbs", _only("phrasal-verb"))
_phrase_query("q_hedging", _only("hedging"))
_phrase_query("q_marketing", _only("marketing"))
_phrase_query("q_dictionary", _only("dictionary-not-approved-word"))
_LISTED = LintConfig(rules=_only("dictionary-not-approved-word", "marketing").rules, blacklist=(PhraseEntry(("item", "users"), ("thing",)), PhraseEntry(("job",))), whitelist=("utilize", "Robust"))
_phrase_query("q_blacklist_whitelist", _LISTED)


@_query(f"WITH {_sql_lines('documents', SEEDED)} SELECT doc_id, line_no AS line, CAST(strpos(line, 'ste-disable-next-line') AS BIGINT) AS col, 'Suppression directive names unknown rule ids: \"bogus-rule\".' AS message FROM lines WHERE contains(line, 'bogus-rule')")
def q_invalid_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_hits(spark, sf_dir, "invalid-suppression").select("doc_id", "line", "col", "message")


@_query(f"WITH {_sql_lines('documents', SEEDED)}, d AS (SELECT doc_id, line_no + 1 AS line_no FROM lines WHERE regexp_matches(line, '^// ste-disable-next-line.*semicolon')) SELECT count(*) AS n_before, count(*) FILTER (d.doc_id IS NULL) AS n_after FROM (SELECT doc_id, line_no, unnest(range(0, CAST(length(line) - length(replace(line, ';', '')) AS INT))) AS i FROM lines) s LEFT JOIN d USING (doc_id, line_no)")
def q_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, docs = _only("semicolon"), _seeded(spark, sf_dir)
    before = rules.line_violations(docs, config).agg(F.count("*").alias("n_before"))
    return before.crossJoin(lint(docs, config).agg(F.count("*").alias("n_after")))  # two single rows


_SQL_LINT = f"""WITH {_sql_lines('documents', SEEDED)}, {_SQL_SENTENCES}, {_SQL_PARAGRAPHS}, {_forms_sql(LintConfig())}, {_SQL_PLACES},
alone AS (SELECT doc_id, line_no AS line, rule_id FROM hits
  UNION ALL SELECT doc_id, line, 'sentence-length' FROM sentences WHERE word_count > 25
  UNION ALL SELECT doc_id, line, 'paragraph-length' FROM paragraphs WHERE n_sentences > 6
  UNION ALL SELECT doc_id, line_no, 'semicolon' FROM (SELECT doc_id, line_no, unnest(range(0, CAST(length(line) - length(replace(line, ';', '')) AS INT))) AS i FROM lines)
  UNION ALL SELECT doc_id, line_no, 'contraction' FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)[A-Za-z0-9_]+[''’](t|re|ve|ll|d|m)\\b')) AS x FROM lines)
  UNION ALL SELECT doc_id, line_no, 'contraction' FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\\b(it|he|she|that|what|who|there|here|let|one|where|how|everyone|everybody|something|nothing|somebody|nobody)[''’]s\\b')) AS x FROM lines)
  UNION ALL SELECT doc_id, line_no, 'invalid-suppression' FROM lines WHERE contains(line, 'bogus-rule')),
gone AS (SELECT doc_id, line_no + 1 AS line, 'semicolon' AS rule_id FROM lines WHERE regexp_matches(line, '^// ste-disable-next-line semicolon')
  UNION ALL SELECT doc_id, line_no + 1, 'hedging' FROM lines WHERE contains(line, 'bogus-rule, hedging')),
found AS (SELECT a.* FROM alone a LEFT JOIN gone g USING (doc_id, line, rule_id) WHERE g.doc_id IS NULL)"""


@_query(f"{_SQL_LINT} SELECT rule_id, CASE WHEN rule_id IN ('hedging', 'marketing') THEN 'soft' ELSE 'hard' END AS severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY rule_id")
def q_lint_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint(_seeded(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@_query(f"{_SQL_LINT} SELECT doc_id, count(f.rule_id) AS total, count(f.rule_id) FILTER (rule_id NOT IN ('hedging', 'marketing')) AS hard, count(f.rule_id) FILTER (rule_id IN ('hedging', 'marketing')) AS soft FROM documents LEFT JOIN found f USING (doc_id) GROUP BY doc_id")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(spark, sf_dir)
    return report.counts(docs.select("doc_id"), lint(docs))


@_query(f"{_SQL_LINT} SELECT lang, source, rule_id, count(*) AS n FROM found JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source, rule_id)")
def q_rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(spark, sf_dir)
    return lint(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").rollup("lang", "source", "rule_id").agg(F.count("*").alias("n"))


@_query(f"{_SQL_LINT}, per AS (SELECT doc_id, count(f.rule_id) AS n FROM documents LEFT JOIN found f USING (doc_id) GROUP BY doc_id) SELECT quality, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_violations FROM per JOIN labels USING (doc_id) GROUP BY quality")
def q_density_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(spark, sf_dir)
    told = report.counts(docs.select("doc_id"), lint(docs)).join(_table(spark, sf_dir, "labels"), "doc_id")
    return told.groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("total").alias("n_violations"))


@_query(f"WITH {_sql_lines('documents', SEEDED)}, n AS (SELECT doc_id, CAST(sum(length(line) - length(replace(line, ';', ''))) AS BIGINT) AS n FROM lines GROUP BY doc_id) SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'doc' || doc_id || ': clean' ELSE 'doc' || doc_id || ': ' || n || ' violation(s), ' || n || ' hard, 0 soft' END AS head, coalesce(n, 0) > 0 AS failed FROM documents LEFT JOIN n USING (doc_id)")
def q_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(spark, sf_dir).withColumn("label", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    told = report.text_reports(docs, rules.line_violations(docs, _only("semicolon")))
    return told.select("doc_id", F.substring_index("report", "\n", 1).alias("head"), "failed")


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'the', 'THE') WHEN n = 1 THEN replace(text, 'the', 'THE') END AS result, CASE WHEN n = 0 THEN 'old_string not found' WHEN n > 1 AND doc_id % 2 = 1 THEN 'old_string found ' || n || ' times' END AS error "
        "FROM (SELECT doc_id, text, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents) WHERE n > 0 UNION ALL SELECT doc_id, NULL, 'old_string not found' FROM documents WHERE NOT contains(text, 'the')")  # fmt: skip
def q_apply_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = diff.apply_edit(F.col("text"), F.lit("the"), F.lit("THE"), F.col("doc_id") % 2 == 0)
    return _docs(spark, sf_dir).select("doc_id", edit.alias("e")).select("doc_id", "e.result", "e.error")


@_query("SELECT doc_id, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT) AS line, CAST(9 AS BIGINT) AS col FROM documents WHERE text <> '' AND NOT ends_with(text, chr(10))")
def q_diff_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _docs(spark, sf_dir).filter("text <> '' and not endswith(text, '\n')").select("doc_id", "kind", F.concat("text", F.lit("\nAn extra; line.")).alias("new"), F.col("text").alias("old"))
    return lint_writes(writes, _only("semicolon")).select("doc_id", "line", "col")


_COMMANDS = (
    "cat docs/a.md > out/b.txt && ./run.sh --file=c.yaml v1.2",
    "git commit -m ''fix; update thing''",
    "git commit --amend --message=''Kick off the plan.''",
    "git commit -m \"fix: $(date)\"",
    "git commit -am ''x; y''",
    "git status && git commit -m ''Clean message.'' docs/a.md docs/a.md",
)
_COMMAND_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COMMANDS)) + " END"


@_query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_COMMAND_SQL}, '[A-Za-z0-9._/~-]*\\.[A-Za-z]{{2,6}}'))), ',') AS paths FROM documents")
def q_path_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(shell.path_mentions(F.expr(_COMMAND_SQL))), ",").alias("paths"))


@_query("SELECT doc_id AS call_id, CASE doc_id % 6 WHEN 1 THEN 'fix; update thing' WHEN 2 THEN 'Kick off the plan.' WHEN 3 THEN 'fix: $(date)' WHEN 5 THEN 'Clean message.' END AS message, doc_id % 6 = 3 AS dynamic FROM documents WHERE doc_id % 6 IN (1, 2, 3, 5)")
def q_commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = _docs(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.expr(_COMMAND_SQL).alias("command"))
    return shell.commit_messages(commands).select("call_id", "message", "dynamic")


@_query("SELECT doc_id AS call_id, CASE doc_id % 6 WHEN 1 THEN 'Writing rules blocked' || chr(10) || ' commit message:' || chr(10) || '- line 1, column 4 [semicolon]: Do not use a semicolon in prose. Write two sentences.' "
        "WHEN 2 THEN 'Writing rules blocked' || chr(10) || ' commit message:' || chr(10) || '- line 1, column 1 [phrasal-verb]: Use an approved word instead of \"kick off\". Suggested fix: use \"start\".' "
        f"ELSE '{gate.UNCHECKED}' END AS reason FROM documents WHERE doc_id % 6 IN (1, 2, 3)")  # fmt: skip
def q_block_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    arguments = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("file_path", "path", "content", "old_string", "new_string")], F.lit(None).cast("boolean").alias("replace_all"), F.expr(_COMMAND_SQL).alias("command"))
    calls = _docs(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.lit("bash").alias("name"), arguments.alias("arguments"))
    files = spark.createDataFrame([], "path string, content string")
    return gate.check_calls(calls, files)[0]


@_query("SELECT doc_id AS call_id, '[simple-english] Post-check of files changed by this command.' || chr(10) || 'Writing-rule violations in d/' || doc_id || '.md:' || chr(10) || '- line ' || (len(string_split(text, chr(10))) + 1) || ', column 9 [semicolon]: Do not use a semicolon in prose. Write two sentences.' || chr(10) || "
        "'Fix the hard violations. A later write to a listed file re-runs this check until the file is clean.' AS report FROM documents WHERE doc_id % 3 = 0 AND text <> '' AND NOT ends_with(text, chr(10))")  # fmt: skip
def q_post_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).filter("text <> '' and not endswith(text, '\n')")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    snapshots = docs.select(F.col("doc_id").alias("call_id"), path.alias("path"), F.col("text").alias("prev"))
    now = docs.select(path.alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nAn extra; line."))).otherwise(F.col("text")).alias("content"))
    open_files = spark.createDataFrame([], "path string, hard bigint")
    return gate.post_check(snapshots, now, open_files, _only("semicolon"))[0]


@_query("SELECT conv_id AS session, arg_max(turn, turn) AS seq, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def q_last_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.last_replies(readers.conversation_events(_table(spark, sf_dir, "conversations")))


def _seeded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''")
    content = F.when((F.col("conv_id") + F.col("turn")) % 3 < 2, F.concat(F.lit("One; two "), F.col("turn").cast("string"), F.lit("."))).otherwise("Fine.")
    return readers.spread(some.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), content.alias("content")))


@_query("WITH RECURSIVE r AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 < 2 THEN 1 ELSE 0 END AS hard, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant' AND trim(text) <> ''), "
        "g AS (SELECT conv_id, turn, i, hard, hard = 1 AS gated, hard AS c FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.i, r.hard, r.hard = 1 AND g.c < 3, CASE WHEN r.hard = 0 THEN 0 WHEN g.c < 3 THEN g.c + 1 ELSE g.c END FROM r JOIN g ON r.conv_id = g.conv_id AND r.i = g.i + 1) "
        "SELECT conv_id AS session, turn AS seq, CAST(hard AS BIGINT) AS hard, gated, CAST(c AS INT) AS gate_count FROM g")  # fmt: skip
def q_reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_replies(gate.linted_replies(_seeded_replies(spark, sf_dir))).select("session", "seq", "hard", "gated", "gate_count")


@_query("WITH s AS (SELECT conv_id AS session, count(*) FILTER (role = 'assistant') AS hard, count(*) FILTER (role = 'user') AS soft FROM conversations GROUP BY conv_id) SELECT session, ' Writing-rule reply: ' || hard || ' hard, ' || soft || ' soft ' AS text, CASE WHEN hard > 0 THEN 'red' WHEN soft > 0 THEN 'yellow' ELSE 'green' END AS fg, hard > 0 OR soft > 0 AS bold FROM s")
def q_status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    states = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(n("assistant").alias("hard"), n("user").alias("soft"))
    return report.status_row(states).select("session", "text", "fg", "bold")


@_query("SELECT doc_id, 1 AS line_no, 'note ' || doc_id || '; plan' AS text FROM documents UNION ALL SELECT doc_id, 2, 'last' FROM documents")
def q_hash_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("#!/bin/sh\nx = 1 # not here\n  #  note "), F.col("doc_id").cast("string"), F.lit("; plan\n#\n# last\n"))
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("hash-source").alias("kind"), source.alias("text"))
    return extract.prose_lines(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "text")


@_query("SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS line_no, unnest(['kick off ' || doc_id, 'block', 'end */', '/ doc', 'one']) AS text FROM documents")
def q_slash_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit('let s = "a\\"b // c"; // kick off '), F.col("doc_id").cast("string"), F.lit("\n/* block\n  end */ x\n/// doc\n/* one */ y\n"))
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("slash-source").alias("kind"), source.alias("text"))
    return extract.prose_lines(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "text")
