"""The lint as a table function of SQL: ``SELECT ... FROM documents, LATERAL lint(text, 'prose-file')``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clearprose.config import PROSE_KINDS, LintConfig
from clearprose.operators import extract, rules, segment
from clearprose.session import ready

SCHEMA = "line bigint, col bigint, rule_id string, severity string, message string, suggestion string"

_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_ARRAY = f"array<struct<{SCHEMA.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>>"
_TYPE = pa.list_(pa.struct([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in SCHEMA.split(", ")]))
#: A number of sentences that no paragraph has.
_NO_CAP = 1 << 40


def hash_comments(text: str) -> list[str]:
    lines = (x.lstrip() for x in text.split("\n"))
    return [t for t in (x[1:].strip() for x in lines if x.startswith("#") and not x.startswith("#!")) if t]


def violations_in(texts: list[str | None], kinds: list[str | None], config: LintConfig) -> list[list[tuple]]:
    """For each text its rows of SCHEMA, in report order; all texts are read together."""
    told = [i for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)) if text and kind in extract.LINTED]
    out: list[list[tuple]] = [[] for _ in texts]
    if not told:
        return out
    kind = [kinds[i] for i in told]
    lines = [hash_comments(texts[i]) if kinds[i] == "hash-source" else [x.removesuffix("\r") for x in texts[i].removesuffix("\n").split("\n")] for i in told]
    is_prose = np.isin(np.array(kind, dtype=object), PROSE_KINDS)
    prose = extract.told_lines(pa.array(lines, pa.list_(pa.string())), pa.array(kind), config.exempt_block_quotes)
    hits, quiet = rules.line_hits(prose, is_prose, config)
    found = [[(h["line"], h["col"], h["rule_id"], h["entry_ord"], h["form_ord"], h["message"], (h["suggestions"] or [None])[0]) for h in of] for of in hits.to_pylist()]
    if config.severity("sentence-length") or config.severity("paragraph-length"):
        sentences, paragraphs = segment.segmented(prose, is_prose, config.sentence_words)
        if config.severity("sentence-length"):
            for of, s in _over(sentences, "word_count", [config.sentence_words] * len(told)):
                snippet = s["text"][:60] + ("..." if len(s["text"]) > 60 else "")
                message = f'{rules.SENTENCE_IS}{s["word_count"]}{rules.SENTENCE_MOST}{config.sentence_words}. "{snippet}"'
                found[of].append((s["line"], s["col"], "sentence-length", s["sent_no"], 0, message, None))
        if config.severity("paragraph-length"):
            caps = [config.paragraph_sentences(k) for k in kind]
            for of, p in _over(paragraphs, "n_sentences", [c or _NO_CAP for c in caps]):
                message = f'{rules.PARAGRAPH_IS}{p["n_sentences"]}{rules.PARAGRAPH_MOST}{caps[of]}.'
                found[of].append((p["line"], 1, "paragraph-length", p["para_no"], 0, message, None))
    for n, (i, of) in enumerate(zip(told, found, strict=True)):
        heard = [h for h in of if h[2] not in quiet.get((n, h[0]), ())]
        heard.sort(key=lambda h: (h[0], h[1], rules.RULE_ORDER.index(h[2]), h[3], h[4]))
        out[i] = [(line, col, rule, config.severity(rule), message, fix) for line, col, rule, _, _, message, fix in heard]
    return out


def _over(lists: pa.ListArray, field: str, most: list[int]) -> Iterator[tuple[int, dict]]:
    """(list, item) of the items whose ``field`` is over what their list may have."""
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = np.flatnonzero(lists.values.field(field).to_numpy() > np.array(most, np.int64)[of])
    yield from zip(of[at].tolist(), lists.values.take(pa.array(at)).to_pylist(), strict=True)


def _found(config: LintConfig):
    """The function that reads a batch of texts, a few together."""

    def run(text: pa.Array, kind: pa.Array) -> pa.Array:
        texts, kinds, out, first, size = text.to_pylist(), kind.to_pylist(), [], 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= segment.SLICE_BYTES or i == len(texts):
                out += violations_in(texts[first:i], kinds[first:i], config)
                first, size = i, 0
        return pa.array([[dict(zip(_NAMES, row, strict=True)) for row in rows] for rows in out], _TYPE)

    return run


def violations_of(text: str | None, kind: str, config: LintConfig) -> list[tuple]:
    """Rows of SCHEMA for one text, in report order."""
    return violations_in([text], [kind], config)[0]


def register(spark: SparkSession, config: LintConfig | None = None, name: str = "lint") -> None:
    """Registers the table function ``name(text, kind)`` with a configuration.

    It is a table function of SQL over an array function, ``name_found(text, kind)``: Spark hands that one
    whole batches of rows, where a Python table function is called for each row. Texts without violations
    stay with LEFT JOIN LATERAL ... ON TRUE; Spark drops them where ON is left out.
    """
    settings = config or LintConfig()
    ready(spark).udf.register(f"{name}_found", F.arrow_udf(_found(settings), _ARRAY))
    fields = ", ".join(f"{c.split()[0]} {c.split()[1].upper()}" for c in SCHEMA.split(", "))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, kind STRING) RETURNS TABLE ({fields}) RETURN SELECT inline({name}_found(text, kind))")
