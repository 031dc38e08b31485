"""The uniform issue table: what every audit returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("check", "code", "field", "entity_id", "other_id", "detail", "severity")


def issues(df: DataFrame, check: str, code: str | Column, field: str | Column, entity: Column, other: Column | None = None, detail: Column | None = None, severity: str = "error") -> DataFrame:
    none = F.lit(None)
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    values = (F.lit(check), text(code), text(field), entity, none if other is None else other, none if detail is None else detail, F.lit(severity))
    return df.select(*(v.cast("string").alias(c) for c, v in zip(COLUMNS, values, strict=True)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_rules(df: DataFrame, check: str, entity: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One issue for each rule (code, field, failing condition) and row, in one pass over the rows."""
    failed = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, field, bad in rules))
    each = df.select(entity.alias("entity"), F.explode(F.array_compact(failed)).alias("e"))
    return issues(each, check, F.col("e.code"), F.col("e.field"), F.col("entity"))


def audit_status(table: DataFrame, structural: list[str], mode_gaps: list[str]) -> DataFrame:
    """One row: issues, structural_ok (no issue whose code begins with one of ``structural``), status pass, pass_with_gaps (only codes of ``mode_gaps``) or fail."""
    begins = lambda prefixes: reduce(Column.__or__, [F.col("code").startswith(p) for p in prefixes], F.lit(False))
    got = table.agg(F.count("*").alias("issues"), F.count_if(begins(structural)).alias("structural"), F.count_if(~begins(mode_gaps)).alias("hard"))
    status = F.when(F.col("issues") == 0, "pass").when(F.col("hard") == 0, "pass_with_gaps").otherwise("fail")
    return got.select("issues", (F.col("structural") == 0).alias("structural_ok"), status.alias("status"))
