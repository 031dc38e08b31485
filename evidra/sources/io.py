"""Strict JSON-lines and multi-file reading, and writing that refuses to overwrite."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators.issues import issues


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files or folders: file, line (from 1 in each file, blank lines counted), value. Paths given twice are read once.

    Lines are counted in one pass for each split of a file; a line's number is the count of the splits before it and its place in its own. The files are read twice and never sorted or shuffled; the
    counts (a row for each split) are broadcast up to ``attach``'s bound. Places are good for one way of packing splits into tasks: if the second pass packs them otherwise, the job fails.
    """
    read = spark.read.text(list(dict.fromkeys([paths] if isinstance(paths, str) else paths)))
    meta = F.col("_metadata")
    raw = read.select("value", meta.file_path.alias("file"), meta.file_block_start.alias("start"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "start", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = settled(blocks.select("file", "start", "task", (F.col("first") - earlier - 1).alias("zero")), "splits")
    place = F.when(F.col("zero").isNull(), F.raise_error(F.lit("the files were split otherwise when their lines were counted; run again")).cast("long")).otherwise(F.col("at") - F.col("zero"))
    return attach(raw, table, ["file", "start", "task"], how="left").select("file", place.alias("line"), "value")


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON objects with their ``file`` and ``line``, and an issue (entity: file, other: line) for each malformed or non-object line. Blank lines are skipped but counted."""
    return parse_lines(numbered_lines(spark, paths).where(F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) != ""), schema)


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of ``lines`` (file, value and perhaps line) as rows, and an issue for each line that is none (malformed, or JSON that isn't an object)."""
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("row").isNotNull() & F.col("row._bad").isNull() & F.ltrim("value").startswith("{")
    numbered = "line" in lines.columns
    good = parsed.where(ok).select("file", *(["line"] if numbered else []), "row.*").drop("_bad")
    return good, issues(parsed.where(~ok), "scan", "malformed_line", "line", F.col("file"), F.col("line") if numbered else None, F.substring("value", 1, 80))


def scan_multi(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several JSON-lines files of one kind as one table with a ``file`` column; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("file", F.col("_metadata.file_path"))


def sink_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table once: an existing one is an error, and a failed write leaves nothing that reads as done."""
    df.write.mode("errorifexists").format(kind).save(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that all executors share (``spark.checkpoint.dir``): what a job needs more than once is computed once, and lineage ends here."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="evidra-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, on: list[str], most: int = 500_000, how: str = "inner") -> DataFrame:
    """``rows`` joined with a settled table of one row for each key: broadcast if it has at most ``most`` rows, else both are shuffled and AQE splits skewed keys."""
    return rows.join(F.broadcast(facts) if facts.limit(most + 1).count() <= most else facts, on, how)
