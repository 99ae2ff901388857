"""The table function of SQL reads whole batches and gives the rows of each text alone."""

from clearprose.config import LintConfig
from clearprose.functions import table

TEXTS = ["One; two.\nIt's to kick off.", None, "", "Fine.", "# a; b\n# c", " ".join(["word"] * 40) + ".", "One. " * 9, "// ste-disable-next-line semicolon\nOne; two."]


def test_a_batch_equals_its_texts():
    kinds = ["prose-file", "prose-file", "prose-file", "skip", "hash-source", "prose-file", "prose-file", "slash-source"]
    got = table.violations_in(TEXTS, kinds, LintConfig())
    assert got == [table.violations_of(t, k, LintConfig()) for t, k in zip(TEXTS, kinds, strict=True)]
    assert [len(x) for x in got[1:4]] == [0, 0, 0] and {h[2] for x in got for h in x} >= {"semicolon", "contraction", "phrasal-verb", "sentence-length", "paragraph-length"}


def test_lateral_reads_batches(spark):
    table.register(spark, name="linted")
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(40)], "doc_id int, text string")
    told = spark.sql("SELECT d.doc_id, v.* FROM {docs} d, LATERAL linted(d.text, 'prose-file') v", docs=docs)
    assert "ArrowEvalPython" in told._jdf.queryExecution().executedPlan().toString()
    want = [(i, *row) for i in range(40) for row in table.violations_of(TEXTS[i % len(TEXTS)], "prose-file", LintConfig())]
    assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, want))
    kept = spark.sql("SELECT DISTINCT d.doc_id FROM {docs} d LEFT JOIN LATERAL linted(d.text, 'prose-file') v ON TRUE", docs=docs)
    assert kept.count() == 40 and spark.sql("SELECT * FROM linted('a; b', 'prose-file')").count() == 1
