"""Declared rules over JSON: a tree of keywords compiled to one column of violations, evaluated in one pass over the rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.issues import issues

FOUND = "array<struct<path:string,code:string>>"
#: Type names as ``schema_of_variant`` begins them.
KINDS = {"null": "VOID", "object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN"}
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
DATE, ZONED, URI = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$", "^[A-Za-z][A-Za-z0-9+.-]*:"
KEYWORDS = {
    *("type", "const", "enum", "pattern", "format", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"),
    *("minItems", "maxItems", "uniqueItems", "items", "contains", "required", "minProperties", "properties", "additionalProperties"),
    *("allOf", "if", "then", "else", "$ref", "$defs", "title", "description"),
}


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(FOUND)


def _get(v: Column, key: str) -> Column:
    if "'" in key:
        raise ValueError(f"a property's name has a quote: {key}")
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _equals(v: Column, kind: Column, value: object) -> Column:
    """Numbers by value, all else by type and text; keys in any order."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return kind.rlike(NUMBER) & (F.try_variant_get(v, "$", "double") == float(value))
    return ~kind.rlike(NUMBER) & (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))


class Rules:
    """``tree``: a rule (true, false or keywords) with ``$defs`` at its top. Unknown keywords, types and formats are refused, and so are references to themselves.

    An integer is a number without a fraction (1.0 is one); numbers are compared as doubles; patterns are searched for anywhere. A keyword says nothing of values of other types, ``properties`` nothing of absent ones.
    """

    def __init__(self, tree: dict | bool) -> None:
        self.tree, self.defs = tree, tree.get("$defs", {}) if isinstance(tree, dict) else {}

    def violations(self, v: Column, rule: dict | bool | None = None, path: Column | None = None, within: tuple[str, ...] = ()) -> Column:
        """(path, code) of all violations of a variant column; codes are keywords. Null (no value): none."""
        rule, path = self.tree if rule is None else rule, F.lit("$") if path is None else path
        one = lambda bad, code, at=path: F.when(bad, F.array(F.struct(at.alias("path"), F.lit(code).alias("code")))).otherwise(F.array().cast(FOUND))
        if isinstance(rule, bool):
            return _joined([] if rule else [one(v.isNotNull(), "false")])
        if unknown := sorted(set(rule) - KEYWORDS):
            raise ValueError(f"unknown keywords: {unknown}")
        kind = F.schema_of_variant(v)
        text, number = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), F.when(kind.rlike(NUMBER), F.try_variant_get(v, "$", "double"))
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        members = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
        out: list[Column] = []

        def of_type(name: str) -> Column:
            if name in ("number", "integer"):
                return number.isNotNull() & (F.lit(True) if name == "number" else number == F.floor(number))
            if name not in KINDS:
                raise ValueError(f"unknown type: {name}")
            return kind.startswith(KINDS[name])

        any_of = lambda tests: reduce(Column.__or__, tests, F.lit(False))
        checks: list[tuple[str, Column]] = []
        if "type" in rule:
            checks.append(("type", ~any_of([of_type(t) for t in ([rule["type"]] if isinstance(rule["type"], str) else rule["type"])])))
        if "const" in rule:
            checks.append(("const", ~_equals(v, kind, rule["const"])))
        if "enum" in rule:
            checks.append(("enum", ~any_of([_equals(v, kind, x) for x in rule["enum"]])))
        if "pattern" in rule:
            checks.append(("pattern", ~text.rlike(rule["pattern"])))
        if "format" in rule:
            formats = {"date": text.rlike(DATE) & text.try_cast("date").isNotNull(), "date-time": text.rlike(ZONED) & text.try_cast("timestamp").isNotNull(), "uri": text.rlike(URI)}
            if rule["format"] not in formats:
                raise ValueError(f"unknown format: {rule['format']}")
            checks.append(("format", text.isNotNull() & ~formats[rule["format"]]))
        limits = {
            "minLength": lambda x: F.char_length(text) < x, "maxLength": lambda x: F.char_length(text) > x, "minimum": lambda x: number < x, "maximum": lambda x: number > x,
            "exclusiveMinimum": lambda x: number <= x, "exclusiveMaximum": lambda x: number >= x, "minItems": lambda x: F.size(items) < x, "maxItems": lambda x: F.size(items) > x,
            "minProperties": lambda x: F.size(members) < x,
        }
        # Spark's size of null is -1 or null by a setting
        there = {"minItems": items, "maxItems": items, "minProperties": members}
        checks += [(k, there.get(k, v).isNotNull() & bad(F.lit(rule[k]))) for k, bad in limits.items() if k in rule]
        out += [one(F.coalesce(v.isNotNull() & bad, F.lit(False)), code) for code, bad in checks]
        if rule.get("uniqueItems"):
            placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.to_json(x).alias("x"), i.alias("i"))))
            again = F.filter(F.transform(placed, lambda e, j: F.when((j > 0) & (F.get(placed, j - 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())
            out.append(self._each(F.transform(again, lambda i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit("uniqueItems").alias("code")))))
        if "items" in rule:
            out.append(self._each(F.flatten(F.transform(items, lambda x, i: self.violations(x, rule["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), within)))))
        if "contains" in rule:
            out.append(one(F.coalesce(items.isNotNull() & ~F.exists(items, lambda x: F.size(self.violations(x, rule["contains"], path, within)) == 0), F.lit(False)), "contains"))
        sub = lambda key: F.concat(path, F.lit("."), key)
        out += [one(F.coalesce(members.isNotNull() & _get(v, key).isNull(), F.lit(False)), "required", sub(F.lit(key))) for key in rule.get("required", [])]
        known = rule.get("properties", {})
        out += [self.violations(F.when(members.isNotNull(), _get(v, key)), child, sub(F.lit(key)), within) for key, child in known.items()]
        extra = rule.get("additionalProperties", True)
        if extra is not True:
            rest = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(list(known)) if known else F.lit(True))
            if extra is False:
                out.append(self._each(F.transform(rest, lambda e: F.struct(sub(e["key"]).alias("path"), F.lit("additionalProperties").alias("code")))))
            else:
                out.append(self._each(F.flatten(F.transform(rest, lambda e: self.violations(e["value"], extra, sub(e["key"]), within)))))
        out += [self.violations(v, child, path, within) for child in rule.get("allOf", [])]
        if "if" in rule:
            said = {k: self.violations(v, rule.get(k, True), path, within) for k in ("then", "else")}
            out.append(F.when(F.size(self.violations(v, rule["if"], path, within)) == 0, said["then"]).otherwise(said["else"]))
        if "$ref" in rule:
            name = rule["$ref"].removeprefix("#/$defs/")
            if name in within or name not in self.defs:
                raise ValueError(f"a reference to nothing or to itself: {rule['$ref']}")
            out.append(self.violations(v, self.defs[name], path, (*within, name)))
        return _joined(out)

    @staticmethod
    def _each(found: Column) -> Column:
        return F.coalesce(found.cast(FOUND), F.array().cast(FOUND))


def declared_rules(df: DataFrame, check: str, entity: Column, text: Column, tree: dict | bool) -> DataFrame:
    """An issue for each violation of ``tree`` in the JSON of ``text``, its path as the field; a null or what isn't JSON is one ``not_json`` at ``$``."""
    parsed = df.select(entity.alias("entity"), F.try_parse_json(text).alias("v"))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("not_json").alias("code")))
    each = parsed.select("entity", F.explode(F.when(F.col("v").isNull(), broken).otherwise(Rules(tree).violations(F.col("v")))).alias("e"))
    return issues(each, check, F.col("e.code"), F.col("e.path"), F.col("entity"))
