"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Three base kinds are found by patterns; a broader kind, ``owned``, takes long mixed
strings. A text's matches leave it as rows of lengths, and their places are running sums
over windows, so work grows with the matches of a text and not with their square. The
hash of every found secret is counted over the whole corpus by distinct owners and
repositories (two partial aggregations, so one value in a third of all rows is no hot key). A broader candidate counts only where at most
``owners`` owners and ``repositories`` repositories have it and it overlaps no base span; a
base span always stays, and is told apart as live-looking (few owners and few repositories)
or as a widely copied example.

Defined results: a null or empty text has no spans. A null owner or repository is
one of its own. Every row is reported, repeated ones and ones with a null id too.
Matches are leftmost and don't overlap within a kind; spans of different kinds may.
A table without the owner or repository column is read as if it were null. An empty table
gives no rows. Other columns, whatever their names, are kept by ``redacted`` and otherwise
ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace, free_names

# The patterns of the base kinds. Runs that are too short never hold a
# longer match of their kind, so access and hex ask for the length at once.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BROAD = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A broader candidate that more owners have is an example, not a secret.
MAX_OWNERS = 2
#: From so many owners on, a base span counts as a widely copied example.
EXAMPLE_OWNERS = 3
#: The same by repositories, for what few owners copy widely among their own.
MAX_REPOSITORIES, EXAMPLE_REPOSITORIES = 5, 6
REDACTED = "[REDACTED]"
#: Code points of a block of a text that is put together anew.
BLOCK = 4096

#: Columns that tell the rows of one text of one owner.
_ROW = ("doc_id", "text_hash", "owner", "repository")


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """What lies before each match, the match and its secret, from the left."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(value)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        value.alias("secret"),
    )
    cells = F.transform(
        pieces,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), x["secret"].alias("secret")
        ),
    )
    return F.when(text.rlike(pattern), cells).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,secret:string>>"))


def _passes(kind: Column, secret: Column) -> Column:
    """Assigned values of six or more characters; broad strings with a letter and at least three digits; every other match."""
    mixed = (F.length(F.regexp_replace(secret, "[^0-9]", "")) >= 3) & secret.rlike("[A-Za-z]")
    return F.when(kind == 0, F.length(secret) >= 6).when(kind == 3, mixed).otherwise(True)


def matches_of(docs: DataFrame) -> DataFrame:
    """A row for each match of each text (doc_id, text_hash, owner, repository, text); a text without one has a row of nulls."""
    text = F.col("text")
    every = F.concat(*(_matches(text, k, pattern, group) for k, (pattern, group) in enumerate(((ASSIGN, 1), (ACCESS, 0), (HEX, 0), (BROAD, 0)))))
    each = docs.select(*_ROW, F.posexplode_outer(every).alias("at", "x"))
    passes = _passes(F.col("x.kind"), F.col("x.secret"))
    return each.select(
        *_ROW,
        (F.coalesce("at", F.lit(0)) == 0).alias("first"),
        *(F.col(f"x.{c}").alias(c) for c in ("kind", "place", "gap", "size")),
        F.when(passes, F.sha2(F.col("x.secret"), 256)).alias("hash"),
    )


def spans_of(matches: DataFrame) -> DataFrame:
    """start, kind, end and hash of the spans: places are running sums of lengths, and broad ones that touch a base one go."""
    one = matches.filter("kind is not null").drop("first").dropDuplicates([*_ROW, "kind", "place"])
    run = Window.partitionBy(*_ROW, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run).cast("int")).withColumn("start", F.col("end") - F.col("size")).filter("hash is not null")
    text = Window.partitionBy(*_ROW)
    before = F.max(F.expr("if(kind < 3, end, null)")).over(text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    # the nearest base span from here on, by a window that grows from the end of the text
    after = F.min(F.expr("if(kind < 3, start, null)")).over(text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    told = placed.withColumn("before", before).withColumn("after", after)
    return told.filter("kind < 3 or (coalesce(before <= start, true) and coalesce(after >= end, true))").select(*_ROW, "start", "kind", "end", "hash")


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text cut in blocks, without a walk from the text's begin."""
    first = F.floor(start / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), ""), start - first * BLOCK + 1, end - start)


class SecretScan:
    """Found spans of a table and the ownership of each secret."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", owners: int = MAX_OWNERS, repositories: int = MAX_REPOSITORIES):
        self.work = Workspace(docs.sparkSession, "secrets")
        self.names = (doc_id, text)
        body = F.coalesce(F.col(text), F.lit(""))
        held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
        named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), held(owner).alias("owner"), F.concat_ws("/", held(owner), held(repository)).alias("repository"), body.alias("text"))
        self.matches = self.work.written(matches_of(named), "matches")
        spans = self.work.written(spans_of(self.matches), "spans")
        by_owner = spans.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        self.ownership = self.work.written(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "ownership")
        judged = spans.select("doc_id", "text_hash", "start", "kind", "end", "hash").distinct().join(self.ownership, "hash")
        kept = judged.filter((F.col("kind") < 3) | ((F.col("owners") <= owners) & (F.col("repositories") <= repositories)))
        left = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
        reached = kept.withColumn("reached", F.coalesce(F.max("end").over(left), F.lit(0)))
        span = F.struct("start", "kind", "end", "owners", "repositories", "reached")
        self.judged = self.work.written(reached.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans")), "judged")

    def report(self) -> DataFrame:
        """One row for each input row: counts, digest of the base spans, all spans, and live and example counts."""
        judged = self.judged.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
        rows = self.matches.filter("first").select("doc_id", "text_hash")
        out = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
        out = out.withColumn("spans", F.coalesce("spans", F.expr("array()").cast(judged.schema["spans"].dataType)))
        base = F.filter("spans", lambda s: s["kind"] < 3)
        counts = [_count("spans", k).alias(f"n_{KINDS[k]}") for k in range(3)]
        live = F.size(F.filter("spans", lambda s: (s["owners"] < EXAMPLE_OWNERS) & (s["repositories"] < EXAMPLE_REPOSITORIES))).cast("long")
        return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_example"))

    def redacted(self, docs: DataFrame) -> DataFrame:
        """The table's rows with every span's text replaced; other columns and the column order stay."""
        doc_id, text = self.names
        of, hash_, own, spans = free_names(docs.columns, "of", "hash", "own", "spans")
        judged = self.judged.select(F.col("doc_id").alias(of), F.col("text_hash").alias(hash_), F.col("spans").alias(spans))
        body = F.coalesce(F.col(text), F.lit(""))
        out = docs.withColumn(own, F.xxhash64(body)).join(judged, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(hash_)), "left")
        apart = F.filter(spans, lambda s: s["start"] >= s["reached"])  # what overlaps the spans before needs no mark of its own

        def cleared(blocks):
            between = F.transform(apart, lambda s: F.concat(_part(blocks, s["reached"], s["start"]), F.lit(REDACTED)))
            return F.concat(F.array_join(between, ""), _part(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(body)))

        # a lambda's argument is computed once, whatever its body names is computed for each of its elements
        clean = F.get(F.transform(F.array(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))), cleared), F.lit(0))
        return out.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)


def scan(docs: DataFrame, **options) -> DataFrame:
    return SecretScan(docs, **options).report()
