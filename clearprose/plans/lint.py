"""The whole lint of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose.config import PROSE_KINDS, SOURCE_KINDS, LintConfig
from clearprose.operators import extract, rules, segment
from clearprose.operators.diff import changed_between, edited_texts
from clearprose.session import ready

_READ = f"hits:array<struct<{rules.HIT}>>,sentences:array<struct<{segment.SENTENCE},hushed:array<string>>>,paragraphs:array<struct<{segment.PARAGRAPH},hushed:array<string>>>,changed:array<bigint>"


def _with_hushed(lists: pa.ListArray, hushed: dict) -> pa.ListArray:
    """A list of structs with a line, and what the line before each turns off."""
    rows = lists.values
    names = pa.nulls(len(rows), pa.list_(pa.string()))
    if hushed:
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())).tolist()
        names = pa.array([hushed.get(k) for k in zip(doc, rows.field("line").to_pylist(), strict=True)], pa.list_(pa.string()))
    fields = [rows.field(i) for i in range(rows.type.num_fields)]
    return pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([*fields, names], [*(f.name for f in rows.type), "hushed"]))


def _over(lists: pa.ListArray, field: str, most: int | None) -> pa.ListArray:
    """The lists with those structs only whose field is over ``most``; without a most, none."""
    rows = lists.values
    kept = rows.field(field).to_numpy() > most if most is not None else np.zeros(len(rows), bool)
    ends = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.filter(pa.array(kept)))


def _read(config: LintConfig, old: bool):
    """The function that reads a batch of documents: hits of lines, sentences, paragraphs, and changed lines where there are old ones."""
    whole = config.severity("sentence-length") or config.severity("paragraph-length")
    # sentences and paragraphs that no rule can report stay here
    caps = [c for c in map(config.paragraph_sentences, (*PROSE_KINDS, *SOURCE_KINDS)) if c > 0]
    most_words = config.sentence_words if config.severity("sentence-length") else None
    most_sentences = min(caps) if caps and config.severity("paragraph-length") else None

    def part(lines: pa.ListArray, kind: pa.Array, was: pa.ListArray | None) -> pa.StructArray:
        prose = extract.told_lines(lines, kind, config.exempt_block_quotes)
        is_prose = np.isin(np.array(kind.to_pylist(), dtype=object), PROSE_KINDS)
        x = segment.lines_in(prose)
        hits, hushed = rules.line_hits(prose, is_prose, config, x)
        sentences, paragraphs = segment.segmented(prose, is_prose, config.sentence_words, x) if whole else segment.segmented(prose.slice(0, 0), is_prose[:0])
        if whole:
            sentences, paragraphs = _over(sentences, "word_count", most_words), _over(paragraphs, "n_sentences", most_sentences)
        else:
            none = pa.array(np.zeros(len(prose) + 1), pa.int32())
            sentences, paragraphs = (pa.ListArray.from_arrays(none, x.values) for x in (sentences, paragraphs))
        changed = pa.nulls(len(prose), pa.list_(pa.int64()))
        if was is not None:
            before = extract.told_lines(was, kind, config.exempt_block_quotes)
            changed = changed_between(before, prose, was.is_null().to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([hits, _with_hushed(sentences, hushed), _with_hushed(paragraphs, hushed), changed], ["hits", "sentences", "paragraphs", "changed"])

    def run(lines: pa.Array, kind: pa.Array, was: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(lines.slice(a, b - a), kind.slice(a, b - a), was.slice(a, b - a)) for a, b in segment.slices(lines, also=was)])

    def run_new(lines: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(lines.slice(a, b - a), kind.slice(a, b - a), None) for a, b in segment.slices(lines)])

    # a filter on what it finds would else move below it with a second evaluation of its own
    return F.arrow_udf(run if old else run_new, f"struct<{_READ}>").asNondeterministic()


def _hits(config: LintConfig, read: Column, kind: Column) -> Column:
    """All hits of a document that no directive turns off, in report order."""
    found = [read["hits"]]
    if config.severity("sentence-length"):
        found.append(rules.sentence_hits(config, read["sentences"]))
    if config.severity("paragraph-length") and config.max_paragraph_sentences != 0:
        found.append(rules.paragraph_hits(config, kind, read["paragraphs"]))
    return rules.reported(rules.heard(F.concat(*found)), config)


def _lines(kind: Column, text: Column) -> Column:
    return F.when(kind.isin(*extract.LINTED), extract.kind_lines(kind, text)).otherwise(F.expr("cast(array() as array<string>)"))


def with_found(rows: DataFrame, kind: Column, text: Column, config: LintConfig | None = None) -> DataFrame:
    """``rows`` with ``found``: the violations of each row's text, in report order, as an array.

    Lines, sentences and paragraphs and what directives turn off are told by one Arrow evaluation;
    no text leaves its row.
    """
    config, kept = config or LintConfig(), rows.columns
    ready(rows.sparkSession)
    read = rows.withColumns({"_kind": kind, "_lines": _lines(kind, text)}).withColumn("_read", _read(config, False)("_lines", "_kind"))
    return read.select(*kept, _hits(config, F.col("_read"), F.col("_kind")).alias("found"))


def with_found_in_change(rows: DataFrame, kind: Column, new: Column, old: Column, config: LintConfig | None = None) -> DataFrame:
    """``rows`` with ``found``, the violations of the new text, and ``changed``, those on changed lines; the same where there is no old text.

    Both texts are read in one row and one evaluation. The filter follows segmentation: a sentence
    counts where the line it is reported on has changed.
    """
    config, kept = config or LintConfig(), rows.columns
    ready(rows.sparkSession)
    lines = {"_kind": kind, "_lines": _lines(kind, new), "_was": F.when(old.isNotNull(), _lines(kind, old))}
    read = rows.withColumns(lines).withColumn("_read", _read(config, True)("_lines", "_kind", "_was"))
    told = read.select(*kept, _hits(config, F.col("_read"), F.col("_kind")).alias("found"), F.col("_read.changed").alias("_at"))
    changed = F.when(F.col("_at").isNull(), F.col("found")).otherwise(F.filter("found", lambda h: F.array_contains("_at", h["line"])))
    return told.select(*kept, "found", changed.alias("changed"))


def lint(docs: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Violations of ``docs`` (doc_id, kind, text): one scan, one Arrow evaluation, no exchange."""
    told = docs.select("doc_id", "kind", "text").filter(F.col("kind").isin(*extract.LINTED))
    told = with_found(told, F.col("kind"), F.col("text"), config)
    return rules.violations(told, "found")


def lint_writes(writes: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Violations of new texts that lie on changed lines.

    ``writes`` has doc_id, kind, new and old; a null old is a new file, whose violations all count.
    """
    told = writes.select("doc_id", "kind", "new", "old").filter(F.col("kind").isin(*extract.LINTED))
    told = with_found_in_change(told, F.col("kind"), F.col("new"), F.col("old"), config)
    return rules.violations(told, "changed")


def lint_edits(edits: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Violations of edits on the lines they change; all of them where there is no content."""
    return lint_writes(edited_texts(edits), config)


def long_sentences_by_language(docs: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """Sentences, long ones and the most words by language of ``docs`` (lang, text)."""
    config = config or LintConfig()
    arrays = extract.prose_arrays(docs.select("lang", F.lit("prose-file").alias("kind"), "text"))
    counts = segment.with_segments(arrays, texts_over=segment.NO_TEXTS).select("lang", F.transform("segments.sentences", lambda s: s["word_count"]).alias("n"))
    told = counts.select("lang", F.explode_outer("n").alias("n")).filter("n is not null")
    return told.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.count(F.when(F.col("n") > config.sentence_words, 1)).alias("n_long"), F.max("n").cast("bigint").alias("max_words"))
