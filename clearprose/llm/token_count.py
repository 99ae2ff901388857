"""Token counts of a piece vocabulary (BPE with byte fallback) by rank-synchronous merging.

The text is normalised as the vocabulary asks (one space put before it, spaces
shown as U+2581), cut before each run of U+2581 (no piece of the vocabulary goes
on after such a cut; checked on loading), and each distinct unit of a batch is
merged once, all units together. Surviving symbols are counted: one each, or their
UTF-8 bytes where the vocabulary lacks them.

Defined results: a null or empty text has no bytes and no tokens; every row is
counted, repeated ones and ones with a null id too. Texts are never cut: a single
unit of any length is merged whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.ragged_bpe import PairTable, merge_all
from clearprose.llm.tables import ready
from clearprose.llm.words import slices

MARK = "▁"
LIMIT = 4096
#: Distinct units whose counts a worker remembers.
REMEMBERED = 1 << 19
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


class PieceCounter:
    """The pieces of one model file and the counts of units met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        number = {model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in number):
            raise ValueError("a piece goes on after a word's end")
        self.known = len(ids)
        symbol = dict(number)
        for c in sorted(set(chain.from_iterable(number))):  # characters that only longer pieces have
            symbol.setdefault(c, len(ids) + len(symbol))
        best = sorted(plain, key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(best)}
        made = [(symbol[p[:k]], symbol[p[k:]], rank[i], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.table = PairTable(*(list(zip(*made, strict=True)) or [[]] * 4))
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.counts: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return _UNITS.findall(MARK + text.replace(" ", MARK))
        return (" " + text).replace(" ", f" {MARK}")[1:].split(" ")

    def learn(self, units: list[str]) -> None:
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols, left = merge_all(self.symbol_of[points], sizes, self.table)
        each = np.ones(len(symbols), np.int64)
        counts = np.bincount(np.repeat(np.arange(len(units)), left), weights=each * ((symbols >= 0) & (symbols < self.known)), minlength=len(units)).astype(np.int64)
        # what the vocabulary lacks stays a single character, and so is found again in the text
        bare = np.flatnonzero(self.symbol_of[points] < 0)
        width = 1 + (points[bare] >= 0x80) + (points[bare] >= 0x800) + (points[bare] >= 0x10000)
        np.add.at(counts, np.repeat(np.arange(len(units)), sizes)[bare], width.astype(np.int64))
        partial = np.flatnonzero(symbols >= self.known)
        if len(partial):
            width_of = {int(self.symbol_of[c]): len(chr(c).encode()) for c in np.flatnonzero(self.symbol_of >= self.known).tolist()}
            np.add.at(counts, np.repeat(np.arange(len(units)), left)[partial], np.array([width_of[s] for s in symbols[partial].tolist()]))
        self.counts.update(zip(units, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.units(t) for t in texts]
        new = set(chain.from_iterable(parts)) - self.counts.keys()
        if new:
            if len(self.counts) + len(new) > REMEMBERED:
                self.counts.clear()
                new = set(chain.from_iterable(parts))
            self.learn(list(new))
        get = self.counts.__getitem__
        return [sum(map(get, p)) for p in parts]


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    ready(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = ["" if t is None else t for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_bytes"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
