"""Checks of annotation records: a row for each code, in order."""

from pyspark.sql import functions as F

from evidra.operators import agreement
from evidra.operators.agreement import annotation_checks

SCHEMA = "file string, line long, rater_id string, annotation_id string, case_id string, label string, session_id string, case_sha256 string, batch string"


def run(spark, rows):
    cases = spark.createDataFrame([("c1", "h1"), ("c2", "h2")], "case_id string, case_sha256 string")
    frame = spark.createDataFrame(rows, SCHEMA)
    found, kept = annotation_checks(frame, cases, F.col("annotation_id").isNotNull(), ["yes", "no"], {"batch": "b"})
    return sorted(((r["entity_id"], r["other_id"], r["code"]) for r in found.collect()), key=str), sorted((r["file"], r["line"]) for r in kept.collect())


def test_each_code_in_order(spark):
    good = ("yes", "s", "h1", "b")
    rows = [
        ("a", 1, "r1", "1", "c1", *good),
        ("a", 2, "r1", None, "c1", *good),  # not of the schema
        ("a", 3, "r1", "1", "c9", *good),  # the id was there: not asked for its case
        ("a", 4, "r1", "4", "c9", *good),
        ("a", 5, "r1", "5", "c2", "yes", "", "h1", None),  # three faults, all named; no first rating of its case
        ("a", 6, "r1", "6", "c2", "maybe", "s", "h2", "b"),
        ("a", 7, "r1", "7", "c2", "no", "s", "h2", "b"),
        ("a", 8, "r1", "8", "c2", "no", None, "h2", "b"),  # a fault, and a second rating
        ("b", 1, "r1", "9", "c1", *good),  # the rater's second file
        ("d", 1, "r2", "4x", "c1", *good),
        ("d", 2, "r3", "5x", "c1", *good),
        ("e", 1, None, "6x", "c1", *good),
        ("f", 1, "r4", "4x", "c1", *good),  # first: file d has gone
    ]
    found, kept = run(spark, rows)
    expected = [
        ("a", "2", "schema_invalid"), ("a", "3", "duplicate_annotation_id"), ("a", "4", "unknown_case"),
        ("a", "5", "missing_session_id"), ("a", "5", "invalid_case_hash"), ("a", "5", "invalid_batch"), ("a", "6", "invalid_label"),
        ("a", "8", "missing_session_id"), ("a", "8", "duplicate_case_rater"), ("b", "1", "duplicate_case_rater"),
        ("b", "a", "duplicate_rater_file"), ("d", None, "mixed_or_missing_rater_file"), ("e", None, "mixed_or_missing_rater_file"),
    ]
    assert found == sorted(expected, key=str)
    assert kept == [("a", 1), ("a", 7), ("f", 1)]


def test_written_records_carry_what_is_kept_and_no_hashes(spark, monkeypatch):
    seen = {}

    def note(df, name, kept=agreement.settled):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(agreement, "settled", note)
    cases = spark.createDataFrame([("c1", "h1")], "case_id string, case_sha256 string")
    frame = spark.createDataFrame([("a", i, "r1", str(i), "c1", "yes", "s", "h%d" % (i % 2), "b") for i in range(4)], SCHEMA)
    found, kept = annotation_checks(frame, cases, F.lit(True), ["yes"], {"batch": "b"}, keep=["label"])
    assert sorted((r["other_id"], r["code"]) for r in found.collect()) == [("0", "invalid_case_hash"), ("2", "duplicate_case_rater"), ("2", "invalid_case_hash"), ("3", "duplicate_case_rater")]
    assert kept.columns == ["label"] and kept.count() == 1
    assert {"case_sha256", "session_id", "batch"}.isdisjoint(seen["records"].columns)


def test_empty(spark):
    assert run(spark, []) == ([], [])
