"""Lines that many documents share, told by keep bitmaps instead of texts; DataFrame functions only.

A line's key is the line without white space at both ends, A-Z in lower case; two
64-bit hashes stand for it. Hashes are dealt by range of (hash, document), so a line
that a third of all documents share lies in many partitions, and sorted by hash,
document and place there: each document's first occurrence of a key streams past and
counts, a partition's counts meet by key. Places of lines that go become one keep bitmap a
document, compressed to its runs of kept lines; a document that keeps all has none.
Only ids, hashes and places are shuffled for that; texts meet their bitmaps last.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points (so empty ones) are always kept; rows that repeat an id are one document
(each distinct text of it has its own bitmap); a row with a null id isn't counted and
keeps all its lines; with ``keep_first`` the occurrence of the smallest document and place
stays (of texts under one id, that of the smaller hash); an empty table gives no rows; other columns
are kept by ``kept_texts``, whatever their names; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace, free_names

MIN_DOCS, MIN_CHARS = 10, 1
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """array<struct<h, h2>> of the lines' keys; null for keys that are too short."""
    keys = F.transform(lines_of(text), lambda x: lower_ascii(F.trim(x, F.lit(_SPACE))))
    both = lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(11), k).alias("h2"))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= max(1, min_chars), both(k)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmap(places: Column, n_lines: Column) -> Column:
    """array<struct<start, length>>: the runs of kept ones of ``n_lines`` lines without those at the sorted ``places`` (from 0)."""
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(n_lines)), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped and keep (runs) of each distinct text of an id that loses lines.

    Lines go whose keys ``min_docs`` documents or more hold; all of them, or with ``keep_first``
    all but the first.
    """
    work = Workspace(docs.sparkSession, "lines")
    hashed = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), _hashes(F.col(text), min_chars).alias("keys"))
    hashed = work.written(hashed, "hashed")
    lines = hashed.select("doc_id", "text_hash", F.posexplode("keys").alias("at", "k")).filter("k is not null").select("k.h", "k.h2", "doc_id", "text_hash", "at")

    dealt = lines.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "h2", "doc_id", "text_hash", "at")
    nth = F.row_number().over(Window.partitionBy("h", "h2", "doc_id").orderBy("text_hash", "at"))
    firsts = dealt.withColumn("nth", nth).filter("nth = 1")
    common = firsts.groupBy("h", "h2").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_hash", "at")).alias("first")).filter(F.col("n_docs") >= min_docs)
    common = work.written(common.select("h", "h2", "first"), "common")

    gone = lines.join(common, ["h", "h2"])
    if keep_first:
        gone = gone.filter(F.struct("doc_id", "text_hash", "at") != F.col("first"))
    places = gone.select("doc_id", "text_hash", "at").distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("at")).alias("places"))
    sizes = hashed.select("doc_id", "text_hash", F.size("keys").alias("n_lines")).distinct()
    told = places.join(sizes, ["doc_id", "text_hash"])
    return told.select("doc_id", "text_hash", F.col("n_lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"), keep_bitmap(F.col("places"), F.col("n_lines")).alias("keep"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All of ``docs`` and n_lines, n_dropped and kept_text (its kept lines, joined by line feeds), named otherwise where docs has such columns."""
    keep, dropped, key, own, lines = free_names(docs.columns, "keep", "n_gone", "key", "own", "lines")
    told = bitmaps.select(F.struct("doc_id", "text_hash").alias(key), F.col("keep").alias(keep), F.col("n_dropped").alias(dropped))
    both = docs.withColumn(own, F.struct(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash")))
    both = both.join(told, F.col(own) == F.col(key), "left").withColumn(lines, lines_of(F.col(text)))
    some = F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    kept = F.when(F.col(keep).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(some, "\n"))
    names = free_names(docs.columns, "n_lines", "n_dropped", "kept_text")
    values = (F.size(lines).cast("long"), F.coalesce(F.col(dropped), F.lit(0)).cast("long"), kept)
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(n) for v, n in zip(values, names, strict=True)])
