"""Declared rules: each keyword against hand-made values."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators.rules import Rules, declared_rules

CASES = [
    ({"type": "integer"}, [1, 1.0, -7], [1.5, "1", True, None, [], {}], "type"),
    ({"type": ["string", "null"]}, ["", None], [0, False, [], {}], "type"),
    ({"type": "number"}, [1, 2.5, 1e300], ["x", True, None], "type"),
    ({"type": "object"}, [{}, {"a": 1}], [[], "x"], "type"),
    ({"type": "array"}, [[], [1]], [{}, "x"], "type"),
    ({"type": "boolean"}, [True, False], [0, "true"], "type"),
    ({"const": "a"}, ["a"], ["b", 1, None], "const"),
    ({"const": 1}, [1, 1.0], [True, "1", 2], "const"),
    ({"const": {"a": 1, "b": [True]}}, [{"b": [True], "a": 1}], [{"a": 1}, {}], "const"),
    ({"enum": ["a", 2, None]}, ["a", 2, None], ["b", 3, False], "enum"),
    ({"pattern": "b+c"}, ["abbcd", 5, None], ["ac", ""], "pattern"),
    ({"format": "date"}, ["2024-02-29", 3], ["2023-02-29", "2024-2-1", "x"], "format"),
    ({"format": "date-time"}, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+00:00"], ["2024-01-01T00:00:00+01:00", "2024-01-01T25:00:00Z", "2024-01-01"], "format"),
    ({"format": "uri"}, ["https://x", "doi:1"], ["x", "//x"], "format"),
    ({"minLength": 2}, ["ab", "\U0001f600a", 1, []], ["a", "", "\U0001f600"], "minLength"),
    ({"maxLength": 2}, ["ab", 123], ["abc"], "maxLength"),
    ({"minimum": 2}, [2, 2.5, "1", True], [1, 1.99], "minimum"),
    ({"maximum": 2}, [2, "9"], [2.01, 10**12], "maximum"),
    ({"exclusiveMinimum": 2}, [2.5], [2, 1], "exclusiveMinimum"),
    ({"exclusiveMaximum": 2}, [1], [2, 3], "exclusiveMaximum"),
    ({"minItems": 1}, [[1], "", {}], [[]], "minItems"),
    ({"maxItems": 1}, [[1], [], "ab"], [[1, 2]], "maxItems"),
    ({"contains": {"const": 3}}, [[1, 3], "x"], [[], [1]], "contains"),
    ({"minProperties": 1}, [{"a": 1}, []], [{}], "minProperties"),
    ({"allOf": [{"minimum": 1}, {"type": "number"}]}, [1], [0], "minimum"),
    (False, [], [1, None, "x", []], "false"),
]


def found(spark, tree, values):
    rows = spark.createDataFrame([(i, v if isinstance(v, bytes) else json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    out = [[] for _ in values]
    for r in declared_rules(rows, "c", F.col("i"), F.col("j"), tree).collect():
        out[int(r["entity_id"])].append((r["field"], r["code"]))
    return [sorted(o) for o in out]


@pytest.mark.parametrize(("tree", "good", "bad", "code"), CASES, ids=lambda x: json.dumps(x)[:40])
def test_keyword(spark, tree, good, bad, code):
    assert found(spark, tree, [*good, *bad]) == [[]] * len(good) + [[("$", code)]] * len(bad)


def test_places_within_arrays_and_objects(spark):
    tree = {
        "type": "object", "required": ["id", "tags"], "additionalProperties": False,
        "properties": {"id": {"type": "integer"}, "tags": {"items": {"$ref": "#/$defs/tag"}, "uniqueItems": True}, "by": {"additionalProperties": {"minimum": 0}}},
        "if": {"required": ["by"]}, "then": {"properties": {"id": {"minimum": 10}}}, "else": {"properties": {"id": {"maximum": 9}}},
        "$defs": {"tag": {"type": "string", "minLength": 1}},
    }
    values = [
        {"id": 3, "tags": ["a", "b"]},
        {"id": 3, "tags": ["a", "", 4, "a", "a"], "x y": 1},
        {"id": 3, "tags": [], "by": {"p": 1, "q": -1}},
        {"tags": None, "id": 12},
        {"id": None},
        [],
    ]
    assert found(spark, tree, values) == [
        [],
        sorted([("$.tags[1]", "minLength"), ("$.tags[2]", "type"), ("$.tags[3]", "uniqueItems"), ("$.tags[4]", "uniqueItems"), ("$.x y", "additionalProperties")]),
        sorted([("$.by.q", "minimum"), ("$.id", "minimum")]),
        [("$.id", "maximum")],
        sorted([("$.id", "type"), ("$.tags", "required")]),
        [("$", "type")],
    ]


def test_what_is_not_json_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, "{}")], "i int, j string")
    got = {(r["entity_id"], r["code"], r["field"]) for r in declared_rules(rows, "c", F.col("i"), F.col("j"), {"type": "object"}).collect()}
    assert got == {("1", "not_json", "$"), ("2", "not_json", "$"), ("3", "not_json", "$")}
    assert declared_rules(rows.limit(0), "c", F.col("i"), F.col("j"), False).count() == 0


@pytest.mark.parametrize("tree", [{"minimun": 1}, {"type": "text"}, {"format": "mail"}, {"properties": {"a": {"oneOf": []}}}, {"$ref": "#/$defs/a"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}])
def test_unknown_words_and_circles_are_refused(spark, tree):
    with pytest.raises(ValueError):
        Rules(tree).violations(F.col("v"))
