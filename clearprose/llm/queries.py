"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearprose.llm import ann, ball_tree, byte_bpe, embedding_dedup, line_dedup, lm_scoring, near_dedup, packing, quality, secrets, spelling, substring_dedup, token_count
from clearprose.llm.tables import bucket_of, read_table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 7) == 2)
    model = lm_scoring.LogFrequencyModel.fit(docs.filter(~F.col("held_out")))
    return model.score(docs, "doc_id", "text", "doc_id", "held_out")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=85)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = quality.training_labels(read_table(spark, sf_dir, "labels"))
    model = quality.train(quality.training_documents(docs), labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    told = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_count": op3_token_count,
    "op4_packing": op4_packing,
    "op5_ann": op5_ann,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_clusters": op12_clusters,
    "op13_spelling": op13_spelling,
}


def _secrets_sql() -> str:
    kinds = ((0, secrets.ASSIGN, 1, "length(secret) >= 6"), (1, secrets.ACCESS, 0, "true"), (2, secrets.HEX, 0, "true"), (3, secrets.BROAD, 0, "length(regexp_replace(secret, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(secret, '[A-Za-z]')"))
    found = []
    for kind, pattern, group, passes in kinds:
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(
            f"SELECT * FROM (SELECT doc_id, source, lang, {kind} AS kind, e - length(m) AS s, e, secret FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM "
            f"(SELECT doc_id, source, lang, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS secret, unnest(gaps[1:len(ms)]) AS gap FROM "
            f"(SELECT doc_id, source, lang, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p}))))) WHERE {passes}"
        )
    name = "['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return (
        f"WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}), "
        "g AS (SELECT * FROM f x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = x.doc_id AND b.kind < 3 AND b.s < x.e AND x.s < b.e)), "
        f"o AS (SELECT secret, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(source, '') || '/' || coalesce(lang, '')) AS repositories FROM g GROUP BY secret), j AS (SELECT doc_id, kind, s, {name} AS told, owners >= {secrets.EXAMPLE_OWNERS} OR repositories >= {secrets.EXAMPLE_REPOSITORIES} AS copied FROM g JOIN o USING (secret) WHERE kind < 3 OR (owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES})) "
        "SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, "
        "sha256(coalesce(string_agg(told, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY s, kind), '') AS spans, "
        "count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_example FROM documents LEFT JOIN j USING (doc_id) GROUP BY doc_id"
    )


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(m) AS component_id, r.doc_id = min(m) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.m),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT r.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(m) AS component_id, r.vec_id = min(m) AS kept FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id"""

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN c USING (key) GROUP BY doc_id"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round of assignment and floored means as a table of its own."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64))",
        f"c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT DISTINCT vec_id, sha256('3:' || vec_id) AS h FROM v) ORDER BY h LIMIT {k}) s USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM v JOIN c{r} m USING (i) GROUP BY vec_id, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} m LEFT JOIN s{r} USING (c, i))")
    return (
        f"WITH {', '.join(parts)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c) "
        f"SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"
    )


# crc32 of letters up to U+00FF and digits, byte by byte over a table of 256 remainders.
_CRC_SQL = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))), "
    "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
)
_SPELLING_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
runs AS (SELECT doc_id, translate(run, {_FOLD}) AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
hashed AS (SELECT run, n, {_CRC_SQL} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM w)),
one AS (SELECT x.word, y.word AS other, y.n AS m FROM x JOIN x y ON x.part = y.part AND x.i = y.i AND x.word <> y.word),
p AS (SELECT * FROM one UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.part = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.part = w.word),
b AS MATERIALIZED (SELECT w.word, w.n, count(other) AS n_near, first(other ORDER BY m DESC, encode(other)) AS best, max(m) AS m FROM w LEFT JOIN p ON p.word = w.word GROUP BY w.word, w.n),
f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM b),
r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.top AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.top WHERE e.form IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": _NEAR_SQL,
    "op8_secrets": _secrets_sql(),
    "op10_embedding_dedup": _VECTORS_SQL,
    "op11_line_dedup": _LINES_SQL,
    "op12_clusters": _clusters_sql(),
    "op13_spelling": _SPELLING_SQL,
}
