"""Agreement over many units: equal units are one row, and no task ranks all units of a rater."""

import hashlib
import re

import pytest

from evidra.operators import agreement as A
from evidra.operators import baselines as B
from evidra.operators import experiments as E


def _noted(monkeypatch, module, seen):
    kept = module.settled

    def note(df, name):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(module, "settled", note)


def test_units_with_equal_counts_are_one_row(spark, monkeypatch):
    seen = {}
    _noted(monkeypatch, A, seen)
    rows = [(u, [1, 1, 2 + u % 2][k]) for u in range(200) for k in range(3)] + [(999, 7), (998, None)]
    got = A.alpha_ordinal(spark.createDataFrame(rows, "unit long, grade long"), "unit", "grade").first()
    n = {1: 400, 2: 100, 3: 100}
    at = {1: 200, 2: 450, 3: 550}
    observed = 100 * sum(2 * 2 * (at[1] - at[x]) ** 2 / 2 for x in (2, 3)) / 600
    expected = sum(2 * n[x] * n[y] * (at[x] - at[y]) ** 2 for x in n for y in n if x < y) / (600 * 599)
    assert got["n"] == 600 and got["alpha"] == pytest.approx(1 - observed / expected)
    assert seen["alike"].count() == 2


def test_order_of_a_raters_units_comes_from_ranges(spark, monkeypatch):
    seen = {}
    _noted(monkeypatch, B, seen)
    raters, units = spark.createDataFrame([(1,), (2,), (2,)], "rater int"), spark.createDataFrame([(u,) for u in range(300)], "unit long")
    got = {(r["rater"], r["unit"]): r["position"] for r in A.rater_order(raters, units, "rater", "unit", "s").collect()}
    digest = lambda r, u: hashlib.sha256(f"s:{r}:{u}".encode()).hexdigest()
    assert got == {(r, u): i for r in (1, 2) for i, u in enumerate(sorted(range(300), key=lambda u: digest(r, u)), 1)}
    assert seen["ranges"].count() > 500


def test_integrity_deals_rows_to_as_many_partitions_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(E, "_ROWS", 3, raising=False)
    packets = spark.createDataFrame([("p1", "A"), ("p1", "A"), ("p2", "A"), ("p3", None), (None, "A")], "packet string, blind string")
    responses = spark.createDataFrame([("r1", "p1", "A"), ("r2", "p1", "A"), ("r2", "p9", "A"), ("r3", "p3", None), (None, "p8", "B")], "response string, packet string, blind string")
    ratings = spark.createDataFrame([("r1", "x", 1), ("r1", "y", 9), ("r1", "y", 2), ("r2", "x", None), ("r2", None, 1), ("r7", "x", 1), ("r7", "x", 1), (None, "x", 1)], "response string, rater string, score int")
    got = E.experiment_integrity(packets, responses, ratings, 2, 4)
    want = [
        ("missing_response", "p2/A", None, None), ("missing_response", "p3", None, None), ("missing_response", "A", None, None),
        ("unknown_packet", "p9/A", None, None), ("unknown_packet", "p3", None, None), ("unknown_packet", "p8/B", None, None), ("repeated_response", "p1/A", None, "2"),
        ("duplicate_response", "r2", None, None), ("too_few_raters", "r2", None, None), ("too_few_raters", "r3", None, None), ("too_few_raters", None, None, None),
        ("unknown_response", "r7", "x", None), ("unknown_response", "r7", "x", None), ("unknown_response", None, "x", None), ("score_range", "r1", "y", None), ("score_range", "r2", "x", None),
    ]
    assert sorted(((r["code"], r["entity_id"], r["other_id"], r["detail"]) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) == {str(18 // 3 + 1)}
