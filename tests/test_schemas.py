"""JSON Schemas as column expressions against a plain validator."""

import json
import math
import random
import re
from collections.abc import Iterator

import pytest
from pyspark.sql import functions as F

from tierscope.functions.structure import canonical_json
from tierscope.operators.schemas import SchemaRegistry, violations

Error = tuple[str, str]  # path, message


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"null": value is None, "boolean": isinstance(value, bool), "string": isinstance(value, str), "array": isinstance(value, list), "object": isinstance(value, dict),
            "number": number and math.isfinite(value), "integer": number and math.isfinite(value) and value == int(value)}[kind] if kind != "integer" or number else False


def _resolve(root: dict, ref: str) -> object:
    at: object = root
    for part in ref.removeprefix("#").strip("/").split("/") if ref not in ("#", "") else []:
        at = at[part.replace("~1", "/").replace("~0", "~")]  # type: ignore[index]
    return at


def errors(value: object, schema: object, root: dict | None = None, path: str = "") -> Iterator[Error]:
    """Every violation as (path, message); a schema is an object, or true or false."""
    if isinstance(schema, bool):
        if not schema:
            yield path, "boolean schema is false"
        return
    root = schema if root is None else root
    sub = lambda v, s, p=path: list(errors(v, s, root, p))
    if "$ref" in schema:
        yield from sub(value, _resolve(root, schema["$ref"]))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, k) for k in kinds):
            yield path, f"must be {','.join(kinds)}"
            return
    if "const" in schema and canonical_json(value) != canonical_json(schema["const"]):
        yield path, "must be equal to constant"
    if "enum" in schema and canonical_json(value) not in map(canonical_json, schema["enum"]):
        yield path, "must be equal to one of the allowed values"
    if _is(value, "number"):
        for key, sign, ok in (("minimum", ">=", lambda a, b: a >= b), ("maximum", "<=", lambda a, b: a <= b), ("exclusiveMinimum", ">", lambda a, b: a > b), ("exclusiveMaximum", "<", lambda a, b: a < b)):
            if key in schema and not ok(value, schema[key]):
                yield path, f"must be {sign} {schema[key]}"
    if isinstance(value, str):
        for key, word, bad in (("minLength", "fewer", len(value) < schema.get("minLength", 0)), ("maxLength", "more", len(value) > schema.get("maxLength", math.inf))):
            if bad:
                yield path, f"must NOT have {word} than {schema[key]} characters"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, f'must match pattern "{schema["pattern"]}"'
    if isinstance(value, list):
        for key, word, bad in (("minItems", "fewer", len(value) < schema.get("minItems", 0)), ("maxItems", "more", len(value) > schema.get("maxItems", math.inf))):
            if bad:
                yield path, f"must NOT have {word} than {schema[key]} items"
        if schema.get("uniqueItems"):
            seen: dict[str, int] = {}
            for i, x in enumerate(map(canonical_json, value)):
                if x in seen:
                    yield path, f"must NOT have duplicate items (items ## {i} and {seen[x]} are identical)"
                    break
                seen[x] = i
        if "items" in schema:
            for i, x in enumerate(value):
                yield from sub(x, schema["items"], f"{path}/{i}")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in value:
                yield path, f"must have required property '{key}'"
        for key, x in value.items():
            at = f"{path}/{key.replace('~', '~0').replace('/', '~1')}"
            if "propertyNames" in schema and sub(key, schema["propertyNames"]):
                yield path, "property name must be valid"
            if key in own:
                yield from sub(x, own[key], at)
            elif schema.get("additionalProperties") is False:
                yield path, "must NOT have additional properties"
            elif "additionalProperties" in schema:
                yield from sub(x, schema["additionalProperties"], at)
    for part in schema.get("allOf", ()):
        yield from sub(value, part)
    if "anyOf" in schema and all(tries := [sub(value, s) for s in schema["anyOf"]]):
        yield from (e for t in tries for e in t)
        yield path, "must match a schema in anyOf"
    if "oneOf" in schema and sum(not sub(value, s) for s in schema["oneOf"]) != 1:
        yield path, "must match exactly one schema in oneOf"
    if "not" in schema and not sub(value, schema["not"]):
        yield path, "must NOT be valid"
    if "if" in schema:
        branch = "else" if sub(value, schema["if"]) else "then"
        if branch in schema and (found := sub(value, schema[branch])):
            yield from found
            yield path, f'must match "{branch}" schema'


def format_errors(found: list[Error]) -> str:
    return "; ".join(f"{path or '/'} {message}" for path, message in found)


RUN = {
    "type": "object", "required": ["id", "tier"], "additionalProperties": False, "$defs": {"hash": {"type": "string", "pattern": "^[a-f0-9]{4}$"}},
    "properties": {"id": {"type": "string", "minLength": 1}, "tier": {"enum": ["T0", "T1"]}, "n": {"type": ["integer", "null"], "minimum": 0}, "hash": {"$ref": "#/$defs/hash"}, "pages": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "integer", "exclusiveMinimum": 0}}, "v": {"const": 1}, "note": {"anyOf": [{"type": "string"}, {"type": "null"}]}},
    "allOf": [{"if": {"properties": {"tier": {"const": "T1"}}, "required": ["tier"]}, "then": {"required": ["n"]}, "else": {"not": {"required": ["hash"]}}}],
}
OTHER = {
    "properties": {"a/b~c": {"type": "object", "additionalProperties": {"type": "number", "maximum": 5}, "propertyNames": {"maxLength": 2}}, "list": {"items": {"oneOf": [{"type": "integer"}, {"minimum": 2}]}, "maxItems": 3}, "never": False, "any": True, "deep": {"properties": {"x": {"items": {"properties": {"y": {"type": "boolean"}}, "required": ["y"]}}}}},
    "not": {"required": ["gone"]}, "exclusiveMaximum": 7,
}


def random_value(rng, depth=0):
    leaf = lambda: rng.choice(["", "a", "T0", "T1", "abcd", 0, 1, 1.0, -1, 2.5, 7, 9, True, None, "zz"])
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return leaf()
    if kind < 0.5:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(0, 5))]
    keys = ["id", "tier", "n", "hash", "pages", "v", "note", "x", "a/b~c", "list", "never", "any", "deep", "y", "gone", "kk", "long"]
    return {k: random_value(rng, depth + 1) for k in rng.sample(keys, rng.randrange(0, 8))}


@pytest.mark.parametrize("schema", [RUN, OTHER])
def test_expressions_against_a_plain_validator(spark, schema):
    rng = random.Random(len(schema))
    values = [random_value(rng) for _ in range(1500)] + [{"id": "a", "tier": t, "n": rng.choice([1, 2.0, None, -1, 1.5]), **rng.choice([{}, {"hash": "abcd"}, {"pages": [1, 2, 1.0]}, {"pages": [3, "x", 0]}, {"note": 3}])} for t in ("T0", "T1", "T2") for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").repartition(4)
    got = {r["i"]: r["v"] for r in df.select("i", SchemaRegistry({"s": schema}).violations("s", "t").alias("v")).collect()}
    for i, v in enumerate(values):
        assert sorted(got[i]) == sorted(f"{p or '/'} {m}" for p, m in errors(v, schema)), v
    assert any(not e for e in got.values()) and sum(len(e) for e in got.values()) > 500


def test_registry(spark):
    registry = SchemaRegistry({"run": RUN})
    rows = spark.createDataFrame([('{"id":"a","tier":"T0"}',), ('{"id":1,"tier":"T0"}',), ("{",), (None,), ("null",)], "t string")
    out = rows.select(registry.violations("run", F.col("t")).alias("v"))
    assert [r["v"] for r in out.collect()] == [[], ["/id must be string"], ["/ must be JSON"], None, ["/ must be object"]]
    assert "Python" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="unknown schema"):
        registry.violations("other", "t")
    with pytest.raises(ValueError, match="refers to itself"):
        violations(F.col("v"), {"properties": {"child": {"$ref": "#"}}})


def test_registry_of_a_folder(spark, tmp_path):
    (tmp_path / "run.schema.json").write_text(json.dumps(RUN))
    registry = SchemaRegistry.read(str(tmp_path), ("run",))
    assert registry.schemas == {"run": RUN}


def test_a_record_is_parsed_once(spark):
    """However often a schema looks at its value."""
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}, "b": {"type": ["integer", "null"], "minimum": 0}}}
    df = spark.createDataFrame([('{"a":"x","b":-1}',), ("{",), (None,)], "t string").select(SchemaRegistry({"s": schema}).violations("s", "t").alias("v"))
    assert [r["v"] for r in df.collect()] == [["/b must be >= 0"], ["/ must be JSON"], None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 2, plan[:2000]
