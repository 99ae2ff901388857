"""Orders, counts and renders violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["line", "col", "rule_ord", "entry_ord", "form_ord"]


def counts(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """Every row of ``docs`` with total, hard and soft."""
    n = violations.groupBy("doc_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("severity") == "hard", 1)).alias("hard"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = docs.join(n, "doc_id", "left")
    return out.select(*docs.columns, zero("total"), zero("hard")).withColumn("soft", F.col("total") - F.col("hard"))


def sorted_violations(violations: DataFrame) -> DataFrame:
    """doc_id and ``found``: its violations in report order."""
    item = F.struct(*ORDER, "rule_id", "severity", "message", "suggestions")
    return violations.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("found"))


def detail(v: Column, bullet: str) -> Column:
    fix = F.when(F.size(v["suggestions"]) > 0, F.concat(F.lit(' Suggested fix: use "'), F.get(v["suggestions"], F.lit(0)), F.lit('".'))).otherwise("")
    return F.concat(F.lit(f"{bullet}line "), v["line"].cast("string"), F.lit(", column "), v["col"].cast("string"), F.lit(" ["), v["rule_id"], F.lit("]: "), v["message"], fix)


def feedback(heading: Column, path: Column, found: Column) -> Column:
    """Heading, path and one line for each violation; empty for none."""
    lines = F.array_join(F.transform(found, lambda v: detail(v, "- ")), "\n")
    return F.when(F.size(found) > 0, F.concat(heading, F.lit(" "), path, F.lit(":\n"), lines)).otherwise("")


def text_reports(docs: DataFrame, violations: DataFrame, hard_only: bool = False) -> DataFrame:
    """doc_id, report and failed: one text report for each row of ``docs`` (doc_id, label)."""
    told = docs.select("doc_id", "label").join(sorted_violations(violations), "doc_id", "left")
    told = told.withColumn("found", F.coalesce("found", F.expr("array()").cast(told.schema["found"].dataType)))
    told = told.withColumn("hard", F.size(F.filter("found", lambda v: v["severity"] == "hard")))
    n = F.size("found")
    head = F.concat("label", F.lit(": "), n.cast("string"), F.lit(" violation(s), "), F.col("hard").cast("string"), F.lit(" hard, "), (n - F.col("hard")).cast("string"), F.lit(" soft"))
    lines = F.array_join(F.transform("found", lambda v: detail(v, "  ")), "\n")
    report = F.when(n == 0, F.concat("label", F.lit(": clean"))).otherwise(F.concat(head, F.lit("\n"), lines))
    return told.select("doc_id", report.alias("report"), ((F.col("hard") > 0) if hard_only else (n > 0)).alias("failed"))


def json_reports(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """doc_id and report: a JSON object of file, kind, total, hard, soft and violations."""
    told = docs.select("doc_id", "label", "kind").join(sorted_violations(violations), "doc_id", "left")
    told = told.withColumn("found", F.coalesce("found", F.expr("array()").cast(told.schema["found"].dataType)))
    hard = F.size(F.filter("found", lambda v: v["severity"] == "hard"))
    item = F.transform("found", lambda v: F.struct(v["rule_id"].alias("rule_id"), v["severity"].alias("severity"), v["line"].alias("line"), v["col"].alias("column"), v["message"].alias("message"), v["suggestions"].alias("suggestions")))
    whole = F.struct(F.col("label").alias("file"), "kind", F.size("found").alias("total"), hard.alias("hard"), (F.size("found") - hard).alias("soft"), item.alias("violations"))
    return told.select("doc_id", F.to_json(whole).alias("report"))


def status_row(state: DataFrame) -> DataFrame:
    """text, fg and bold of each row of ``state`` (hard, soft)."""
    text = F.concat(F.lit(" Writing-rule reply: "), F.col("hard").cast("string"), F.lit(" hard, "), F.col("soft").cast("string"), F.lit(" soft "))
    color = F.when(F.col("hard") > 0, "red").when(F.col("soft") > 0, "yellow").otherwise("green")
    return state.withColumn("text", text).withColumn("fg", color).withColumn("bold", (F.col("hard") > 0) | (F.col("soft") > 0))
