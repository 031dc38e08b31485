"""Files of JSON lines: numbers of lines over several files and splits."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from evidra.sources import dense, io


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_lines_of_files_above_and_below_a_split(spark, tmp_path, small_splits):
    rng = random.Random(2)
    want = {}
    for name, n in (("long.jsonl", 900), ("short.jsonl", 3), ("blank.jsonl", 5), ("empty.jsonl", 0), ("wide.jsonl", 4)):
        lines = ["" if name == "blank.jsonl" or rng.random() < 0.2 else f"{name} {i} " + "x" * rng.randrange(2000 if name == "wide.jsonl" else 40) for i in range(n)]
        (tmp_path / name).write_bytes(("\r\n" if name == "short.jsonl" else "\n").join(lines).encode())
        while lines and not lines[-1]:
            lines.pop()
        want |= {(name, i): v for i, v in enumerate(lines, 1)}
    with gzip.open(tmp_path / "packed.jsonl.gz", "wt") as f:
        f.write("\n".join(f"packed {i}" for i in range(300)))
    want |= {("packed.jsonl.gz", i + 1): f"packed {i}" for i in range(300)}
    got = io.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 20
    rows = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect()]
    assert len(rows) == len({(f, i) for f, i, _ in rows})
    assert {(f, i): v for f, i, v in rows if v} == {k: v for k, v in want.items() if v}


def test_issues_carry_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n \t\n{"k": 2\n[1]\n{"k": 3}\n')
    (tmp_path / "b.jsonl").write_text('7\n{"k": 4}\nnull\n"{}"\n{"k": "x"}\n')
    paths = [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl", f"{tmp_path}/a.jsonl"]
    good, bad = io.scan_jsonl(spark, paths, "k long")
    assert sorted((r["file"][-7:], r["line"], r["k"]) for r in good.collect()) == [("a.jsonl", 1, 1), ("a.jsonl", 6, 3), ("b.jsonl", 2, 4)]
    assert sorted((r["entity_id"][-7:], r["other_id"], r["detail"]) for r in bad.collect()) == [
        ("a.jsonl", "4", '{"k": 2'), ("a.jsonl", "5", "[1]"), ("b.jsonl", "1", "7"), ("b.jsonl", "3", "null"), ("b.jsonl", "4", '"{}"'), ("b.jsonl", "5", '{"k": "x"}'),
    ]


def test_files_packed_otherwise_fail(spark, tmp_path, small_splits):
    (tmp_path / "a.jsonl").write_text("\n".join(f"line {i}" for i in range(2000)))
    lines = io.numbered_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1100")
    with pytest.raises(Exception, match="run again"):
        lines.select("line", "value").write.format("noop").mode("overwrite").save()


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.scan_jsonl(spark, f"{tmp_path}/none.jsonl", "k long")


def test_dense_rows_equal_inline_vectors_and_changes_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 40)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [1.0, None, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "k long, v array<float>")
    folder = f"{tmp_path}/dense"
    index, bad = dense.sink_dense(frame.repartition(3), "k", "v", 5, folder)
    assert sorted(r["entity_id"] for r in bad.collect()) == ["60", "61", "62"]
    vectors, issues = dense.scan_dense(spark, index, folder, 5)
    want = {r["k"]: r["v"] for r in frame.where("k < 60").collect()}
    assert {r["key"]: r["vector"] for r in vectors.collect()} == want
    assert issues.count() == 0

    place = {r["key"]: (r["file"], r["row"]) for r in index.collect()}
    changed = place[7]
    data = bytearray((tmp_path / "dense" / changed[0]).read_bytes())
    data[changed[1] * 20 + 3] ^= 1
    (tmp_path / "dense" / changed[0]).write_bytes(bytes(data) + b"xx")
    other = index.where("key <> 9").unionByName(index.where("key = 11").withColumn("key", F.lit(12_000).cast("long"))).unionByName(index.where("key = 4").withColumns({"row": F.lit(10**6).cast("long"), "key": F.lit(100).cast("long")}))
    vectors, issues = dense.scan_dense(spark, other.unionByName(index.where("key = 5").withColumns({"file": F.lit("none.f32"), "key": F.lit(101).cast("long")})), f"file://{folder}", 5)
    assert {(r["code"], r["entity_id"]) for r in issues.collect()} == {("missing_row", "100"), ("missing_row", "101"), ("changed_row", "7"), ("repeated_pointer", "11"), ("unreferenced_row", f"{place[9][0]}:{place[9][1]}")}
    assert {r["key"]: r["vector"] for r in vectors.collect()} == {k: v for k, v in want.items() if k not in (7, 9)} | {12_000: want[11]}


def test_no_dense_rows(spark, tmp_path):
    index, bad = dense.sink_dense(spark.createDataFrame([], "k string, v array<double>"), "k", "v", 3, f"{tmp_path}/none")
    vectors, issues = dense.scan_dense(spark, index, f"{tmp_path}/none", 3)
    assert (vectors.count(), issues.count(), bad.count()) == (0, 0, 0)
