"""Rules over prose lines, sentences and paragraphs.

Rules that look at single lines share one walk over the text of a batch: an automaton
of all forms, the places of marks and apostrophes, and the few lines with a directive. Work
after the walk grows with what is found. Hits carry the rules that a directive on the line
before turns off, so nothing is joined; severities, caps and suppression are
expressions over the hits of a row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearprose import dictionary
from clearprose.config import PROSE_KINDS, REGISTERED, RULE_ORDER, SOURCE_KINDS, LintConfig
from clearprose.operators import extract
from clearprose.operators.segment import Lines, lines_in, slices

VIOLATION = ["doc_id", "rule_id", "severity", "message", "suggestions", "line", "col", "rule_ord", "entry_ord", "form_ord"]

# What may follow the apostrophe of a contraction, the words that take 's, and the directive's name.
_ENDINGS = "t re ve ll d m".split()
_CLOSED = frozenset("it he she that what who there here let one where how everyone everybody something nothing somebody nobody".split())
DIRECTIVE = "ste-disable-next-line"
# The messages.
CONTRACTION = 'Do not use a contraction. Write the words in full. Found "{}".'
SEMICOLON = "Do not use a semicolon in prose. Write two sentences."
PHRASE = 'Use an approved word instead of "{}".'
NO_IDS, UNKNOWN_IDS = "Suppression directive must name at least one rule id.", "Suppression directive names unknown rule ids: {}."
SENTENCE_IS, SENTENCE_MOST = "Sentence has ", " words; the maximum is "
PARAGRAPH_IS, PARAGRAPH_MOST = "Paragraph has ", " sentences; the maximum is "

_DIRECTIVE = re.compile(rf"\s*(?:///|//|#)?\s*!?\s*{DIRECTIVE}(.*)", re.DOTALL)
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
_APOSTROPHE = regex.compile(rf"['’](s|{'|'.join(_ENDINGS)})(?!{_WORD})", regex.I)
_BEFORE = regex.compile(rf"(?r){_WORD}+")  # read backwards
#: What a form's neighbours may not be.
_TOUCHING = regex.compile(r"[\p{Alphabetic}\p{N}]")

HIT = "line:bigint,rule_id:string,message:string,suggestions:array<string>,col:bigint,entry_ord:int,form_ord:int,hushed:array<string>"
_HIT_TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
_HIT_NAMES = [f.split(":")[0] for f in HIT.split(",")]


@lru_cache(maxsize=8)
def _automaton(forms: tuple) -> ahocorasick.Automaton | None:
    """All forms in one automaton; each holds its entries."""
    by_form: dict[str, list] = {}
    for row in forms:
        by_form.setdefault(row[3], []).append(row)
    out = ahocorasick.Automaton()
    for form, rows in by_form.items():
        if "\n" not in form:  # no line holds it
            out.add_word(form, (len(form), rows))
    if not len(out):
        return None
    out.make_automaton()
    return out


class Text:
    """The lines of a batch as one text."""

    def __init__(self, text: str, sizes: np.ndarray):
        self.text, self.starts = text, (np.cumsum(sizes + 1) - sizes - 1).tolist()
        self.last = (0, 0, 1)  # the place told last: later ones of its line are told from there

    def place(self, p: int) -> tuple[int, int]:
        """The line of a character, and its byte column from 1."""
        line = bisect_right(self.starts, p) - 1
        _, at, col = self.last if self.last[0] == line and self.last[1] <= p else (line, self.starts[line], 1)
        self.last = (line, p, col + len(self.text[at:p].encode()))
        return line, self.last[2]


def _phrases(low: Text, forms: tuple) -> list[tuple]:
    """(line, rule, message, suggestion, col, entry, form) of every form that stands alone, overlapping ones too."""
    automaton, out, text = _automaton(forms), [], low.text
    for last, (size, rows) in automaton.iter(text) if automaton else ():
        at = last + 1 - size
        if (at and _TOUCHING.match(text[at - 1])) or _TOUCHING.match(text[last + 1 : last + 2]):
            continue
        line, col = low.place(at)
        out += [(line, rule, PHRASE.format(phrase), [s], col, entry, form) for rule, entry, form, _, phrase, s in rows]
    return out


def _contractions(all_lines: Text) -> list[tuple]:
    """Verbal contractions (entry 0) and 's after a closed list of words (entry 1)."""
    out, text, done = [], all_lines.text, [-1, -1]
    for m in _APOSTROPHE.finditer(text):
        closed = m[1].lower() == "s"
        line = bisect_right(all_lines.starts, m.start()) - 1
        before = _BEFORE.match(text, all_lines.starts[line], m.start())
        word = before[0] if before else ""
        # a word that the match before it ends in is no word of its own
        if not word or before.start() < done[closed] or (closed and word.lower() not in _CLOSED):
            continue
        done[closed] = m.end()
        _, col = all_lines.place(before.start())
        out.append((line, "contraction", CONTRACTION.format(text[before.start() : m.end()]), None, col, int(closed), 0))
    return out


def directive_names(line: str) -> list[str] | None:
    """Names after a directive at the line's beginning; None for other lines."""
    m = _DIRECTIVE.match(line)
    return [n for n in re.split(r"[\s,:]+", m[1]) if n] if m else None


def _directives(x: Lines) -> tuple[list[tuple], dict[int, list[str]]]:
    """Hits of bad directives, and the registered names of each line with a directive; only lines that hold its name are decoded."""
    raw, sought = x.data[:-3].tobytes(), DIRECTIVE.encode()
    out, names, at = [], {}, raw.find(sought)
    while at >= 0:
        line = int(x.line_of(at))
        low, high = int(x.low[line]), int(x.high[line])
        if at + len(sought) > high:  # over the line's end
            at = raw.find(sought, at + 1)
            continue
        if (found := directive_names(raw[low:high].decode())) is not None:
            unknown = [n for n in found if n not in REGISTERED]
            names[line] = [n for n in found if n in REGISTERED]
            if unknown or not found:
                message = UNKNOWN_IDS.format(", ".join(f'"{n}"' for n in unknown)) if found else NO_IDS
                out.append((line, "invalid-suppression", message, None, at - low + 1, 0, 0))
        at = raw.find(sought, high)  # a line's first name tells all of it
    return out, names


def _strings(prose: pa.ListArray) -> list[str]:
    bounds = prose.offsets
    return prose.values.slice(bounds[0].as_py(), bounds[-1].as_py() - bounds[0].as_py()).to_pylist()


def line_hits(prose: pa.ListArray, is_prose: np.ndarray, config: LintConfig, x: Lines | None = None) -> tuple[pa.ListArray, dict[tuple[int, int], list[str]]]:
    """Hits of the line rules that are on, a list a document, and by (document, line) the rules that the line before turns off.

    The lines (``x``, where they are at hand) become one text only for rules that read characters.
    """
    x, forms = x or lines_in(prose), tuple(dictionary.rows(config))
    lines = _strings(prose) if forms or config.severity("contraction") else []
    text = "\n".join(lines)
    found, names = _directives(x)
    hushed = {(int(x.doc[k]), int(x.no[k]) + 1): v for k, v in names.items() if v}
    if not config.severity("invalid-suppression"):
        found = []
    if config.severity("contraction"):
        found += _contractions(Text(text, np.array([len(v) for v in lines], np.int64)))
    if config.severity("semicolon"):
        marks = np.flatnonzero(x.data == ord(";"))
        line = x.line_of(marks)
        mine = is_prose[x.doc[line]] if len(line) else np.zeros(0, bool)
        found += [(k, "semicolon", SEMICOLON, None, col, 0, 0) for k, col in zip(line[mine].tolist(), (marks - x.at[line] + 1)[mine].tolist(), strict=True)]
    if forms:
        low = text.lower()
        found += _phrases(Text(low, np.array([len(v) for v in low.split("\n")], np.int64)), forms)
    found.sort(key=lambda h: h[0])
    doc = x.doc[[h[0] for h in found]] if found else np.zeros(0, np.int64)
    line = [int(x.no[h[0]]) for h in found]
    cells = [line, *([h[k] for h in found] for k in range(1, 7)), [hushed.get((int(d), n)) for d, n in zip(doc, line, strict=True)]]
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cells, _HIT_TYPES, strict=True)], _HIT_NAMES)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(prose) + 1)), pa.int32()), rows), hushed


#: A violation in an array, in the order of the report.
FOUND = ["line", "col", "rule_ord", "entry_ord", "form_ord", "rule_id", "severity", "message", "suggestions"]


def reported(hits: Column, config: LintConfig) -> Column:
    """The hits with severity and the rule's place in the report order, sorted as a report has them."""
    rows = [(r, config.severity(r), i) for i, r in enumerate(RULE_ORDER) if config.severity(r)]
    def row(h: Column) -> Column:
        severity, order = F.lit(None).cast("string"), F.lit(None).cast("int")
        for rule, level, i in rows:
            severity, order = F.when(h["rule_id"] == rule, level).otherwise(severity), F.when(h["rule_id"] == rule, i).otherwise(order)
        return F.struct(h["line"].alias("line"), h["col"].alias("col"), order.alias("rule_ord"), h["entry_ord"].alias("entry_ord"), h["form_ord"].alias("form_ord"), h["rule_id"].alias("rule_id"), severity.alias("severity"), h["message"].alias("message"), h["suggestions"].alias("suggestions"))

    return F.array_sort(F.transform(hits, row))


def violations(told: DataFrame, column: str) -> DataFrame:
    """A row for each violation in an array column of ``told`` (doc_id and others).

    The outer form, as Spark would look for empty arrays first, below exchanges, and so read every text twice.
    """
    return told.select("doc_id", F.inline_outer(column)).filter("rule_id is not null").select(*VIOLATION)


def line_violations(docs: DataFrame, config: LintConfig) -> DataFrame:
    """Violations of contraction, semicolon, phrase and directive rules of documents (doc_id, kind, text), suppressed ones too."""

    def run(lines: pa.Array, kind: pa.Array) -> pa.Array:
        parts = []
        for a, b in slices(lines):
            prose = extract.told_lines(lines.slice(a, b - a), kind.slice(a, b - a), config.exempt_block_quotes)
            parts.append(line_hits(prose, np.isin(np.array(kind.slice(a, b - a).to_pylist(), dtype=object), PROSE_KINDS), config)[0])
        return pa.concat_arrays(parts)

    told = extract.with_lines(docs.select("doc_id", "kind", "text")).select("doc_id", F.arrow_udf(run, f"array<struct<{HIT}>>")("lines", "kind").alias("hits"))
    return violations(told.select("doc_id", reported(F.col("hits"), config).alias("found")), "found")


def _hit(rule: str, line: Column, message: Column, col: Column, entry: Column, hushed: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        line.alias("line"), F.lit(rule).alias("rule_id"), message.alias("message"), none.cast("array<string>").alias("suggestions"),
        col.cast("bigint").alias("col"), entry.cast("int").alias("entry_ord"), F.lit(0).alias("form_ord"), hushed.alias("hushed"),
    )


def sentence_hits(config: LintConfig, sentences: Column) -> Column:
    """Hits of sentences (line, col, word_count, sent_no, text, hushed) with too many words."""
    most = config.sentence_words

    def hit(s: Column) -> Column:
        snippet = F.concat(F.left(s["text"], F.lit(60)), F.when(F.char_length(s["text"]) > 60, "...").otherwise(""))
        message = F.concat(F.lit(SENTENCE_IS), s["word_count"].cast("string"), F.lit(f'{SENTENCE_MOST}{most}. "'), snippet, F.lit('"'))
        return _hit("sentence-length", s["line"], message, s["col"], s["sent_no"], s["hushed"])

    return F.transform(F.filter(sentences, lambda s: s["word_count"] > most), hit)


def paragraph_hits(config: LintConfig, kind: Column, paragraphs: Column) -> Column:
    """Hits of paragraphs (line, n_sentences, para_no, hushed) with more sentences than their kind allows."""
    cap = F.lit(0)
    for name in (*PROSE_KINDS, *SOURCE_KINDS):
        cap = F.when(kind == name, config.paragraph_sentences(name)).otherwise(cap)

    def hit(p: Column) -> Column:
        message = F.concat(F.lit(PARAGRAPH_IS), p["n_sentences"].cast("string"), F.lit(PARAGRAPH_MOST), cap.cast("string"), F.lit("."))
        return _hit("paragraph-length", p["line"], message, F.lit(1), p["para_no"], p["hushed"])

    return F.transform(F.filter(paragraphs, lambda p: (cap > 0) & (p["n_sentences"] > cap)), hit)


def heard(hits: Column) -> Column:
    """The hits without those whose rule the line before turns off."""
    return F.filter(hits, lambda h: h["hushed"].isNull() | ~F.array_contains(h["hushed"], h["rule_id"]))
