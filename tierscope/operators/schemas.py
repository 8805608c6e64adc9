"""Schema registry: JSON Schemas (draft 2020-12, the keywords that record schemas use) as column expressions over VARIANT.

A schema is turned into one expression that gives the list of what a record violates, so records are checked where they
are read, within the engine's own plan. Every violation is told, "path message" each. A schema that refers to itself has
no such expression and is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the record schemas.
SCHEMA_NAMES = ("benchmark-config", "corpus", "inspection", "sample", "artifact", "provider-probe", "provider-run", "decision", "annotation", "run", "paper-value")

_NONE = "array<string>"


def _no() -> Column:
    return F.array().cast(_NONE)


def _told(path: Column, message: str | Column, when: Column) -> Column:
    """A violation if a condition holds (null: it doesn't)."""
    text = F.concat(F.when(path == "", "/").otherwise(path), F.lit(" "), message if isinstance(message, Column) else F.lit(message))
    return F.when(F.coalesce(when, F.lit(False)), F.array(text)).otherwise(_no())


def _kind(v: Column, *kinds: str) -> Column:
    """Whether a value is of one of the JSON types."""
    of = F.schema_of_variant(v)
    number = of.isin("BIGINT", "DOUBLE", "FLOAT") | of.startswith("DECIMAL")
    as_double = F.try_variant_get(v, "$", "double")
    tests = {"null": of == "VOID", "boolean": of == "BOOLEAN", "string": of == "STRING", "array": of.startswith("ARRAY"), "object": of.startswith("OBJECT"), "number": number, "integer": number & (as_double == F.floor(as_double).cast("double"))}
    return F.coalesce(reduce(lambda a, b: a | b, (tests[k] for k in kinds)), F.lit(False))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _plain(v: Column) -> Column:
    """JSON to compare by: keys are sorted already, numbers by their value."""
    return F.when(_kind(v, "number"), F.concat(F.lit("#"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(F.to_json(v))


def _same(v: Column, value: object) -> Column:
    return _plain(v) == _plain(F.parse_json(F.lit(json.dumps(value))))


def _resolve(root: dict, ref: str) -> object:
    at: object = root
    for part in ref.removeprefix("#").strip("/").split("/") if ref not in ("#", "") else []:
        at = at[part.replace("~1", "/").replace("~0", "~")]  # type: ignore[index]
    return at


def _property(name: str) -> str:
    return '$["' + name + '"]'


def violations(v: Column, schema: object, root: dict | None = None, path: Column | None = None, within: tuple[str, ...] = ()) -> Column:
    """What a value (a VARIANT; none if SQL null) violates of a schema, an object or true or false."""
    path = F.lit("") if path is None else path
    if isinstance(schema, bool):
        return _no() if schema else F.when(v.isNotNull(), _told(path, "boolean schema is false", F.lit(True))).otherwise(_no())
    root = schema if root is None else root
    sub: Callable[..., Column] = lambda x, s, p=path: violations(x, s, root, p, within)
    found: list[Column] = []
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise ValueError(f"a schema that refers to itself can't be checked in columns: {schema['$ref']}")
        found.append(violations(v, _resolve(root, schema["$ref"]), root, path, (*within, schema["$ref"])))
    if "const" in schema:
        found.append(_told(path, "must be equal to constant", ~_same(v, schema["const"])))
    if "enum" in schema:
        found.append(_told(path, "must be equal to one of the allowed values", ~reduce(lambda a, b: a | b, (_same(v, x) for x in schema["enum"]), F.lit(False))))
    number = F.when(_kind(v, "number"), F.try_variant_get(v, "$", "double"))
    for key, sign, ok in (("minimum", ">=", number.__ge__), ("maximum", "<=", number.__le__), ("exclusiveMinimum", ">", number.__gt__), ("exclusiveMaximum", "<", number.__lt__)):
        if key in schema:
            found.append(_told(path, f"must be {sign} {schema[key]}", ~ok(schema[key])))
    text = F.when(_kind(v, "string"), F.try_variant_get(v, "$", "string"))
    sizes = [("Length", F.length(text), "characters"), ("Items", F.when(_kind(v, "array"), F.size(_items(v))), "items")]
    for what, size, unit in sizes:
        for key, word, bad in ((f"min{what}", "fewer", size.__lt__), (f"max{what}", "more", size.__gt__)):
            if key in schema:
                found.append(_told(path, f"must NOT have {word} than {schema[key]} {unit}", bad(schema[key])))
    if "pattern" in schema:
        found.append(_told(path, f'must match pattern "{schema["pattern"]}"', ~text.rlike(schema["pattern"])))
    if schema.get("uniqueItems"):
        plain = F.transform(_items(v), _plain)
        again = F.filter(F.transform(plain, lambda x, i: F.when(F.array_position(plain, x) <= i, i)), lambda i: i.isNotNull())
        first = F.try_element_at(again, F.lit(1))
        found.append(_told(path, F.concat(F.lit("must NOT have duplicate items (items ## "), first.cast("string"), F.lit(" and "), (F.array_position(plain, F.get(plain, first)) - 1).cast("string"), F.lit(" are identical)")), _kind(v, "array") & first.isNotNull()))
    if "items" in schema:
        inside = F.flatten(F.transform(_items(v), lambda x, i: sub(x, schema["items"], F.concat(path, F.lit("/"), i.cast("string")))))
        found.append(F.when(_kind(v, "array"), inside).otherwise(_no()))
    own = schema.get("properties", {})
    rest = schema.get("additionalProperties", True)
    members: list[Column] = []
    for key in schema.get("required", ()):
        members.append(_told(path, f"must have required property '{key}'", F.try_variant_get(v, _property(key), "variant").isNull()))
    for key, part in own.items():
        members.append(sub(F.try_variant_get(v, _property(key), "variant"), part, F.concat(path, F.lit("/" + key.replace("~", "~0").replace("/", "~1")))))
    if rest is not True or "propertyNames" in schema:
        entries = F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        if "propertyNames" in schema:
            members.append(F.flatten(F.transform(entries, lambda e: _told(path, "property name must be valid", F.size(sub(F.try_variant_get(F.try_parse_json(F.to_json(F.struct(e["key"].alias("k")))), "$.k", "variant"), schema["propertyNames"])) > 0))))
        if rest is not True:
            more = F.filter(entries, lambda e: ~e["key"].isin(*own) if own else F.lit(True))
            at = lambda e: F.concat(path, F.lit("/"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
            members.append(F.flatten(F.transform(more, lambda e: _told(path, "must NOT have additional properties", F.lit(True)) if rest is False else sub(e["value"], rest, at(e)))))
    if members:
        found.append(F.when(_kind(v, "object"), F.concat(*members)).otherwise(_no()))
    found += [sub(v, part) for part in schema.get("allOf", ())]
    if "anyOf" in schema:
        tries = [sub(v, s) for s in schema["anyOf"]]
        none = reduce(lambda a, b: a & b, (F.size(t) > 0 for t in tries))
        found.append(F.when(none, F.concat(*tries, _told(path, "must match a schema in anyOf", F.lit(True)))).otherwise(_no()))
    if "oneOf" in schema:
        fitting = reduce(lambda a, b: a + b, ((F.size(sub(v, s)) == 0).cast("int") for s in schema["oneOf"]))
        found.append(_told(path, "must match exactly one schema in oneOf", fitting != 1))
    if "not" in schema:
        found.append(_told(path, "must NOT be valid", F.size(sub(v, schema["not"])) == 0))
    if "if" in schema:
        fits = F.size(sub(v, schema["if"])) == 0
        for branch, taken in (("then", fits), ("else", ~fits)):
            if branch in schema:
                inner = sub(v, schema[branch])
                found.append(F.when(taken & (F.size(inner) > 0), F.concat(inner, _told(path, f'must match "{branch}" schema', F.lit(True)))).otherwise(_no()))
    out = F.concat(*found) if found else _no()
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        # A value of another type is told once, and nothing else of it.
        before = found[0] if "$ref" in schema else _no()
        out = F.when(_kind(v, *kinds), out).otherwise(F.concat(before, _told(path, f"must be {','.join(kinds)}", F.lit(True))))
    return F.when(v.isNull(), _no()).otherwise(out)


class SchemaRegistry:
    """Schemas by name."""

    def __init__(self, schemas: dict[str, dict]):
        self.schemas = schemas

    @classmethod
    def read(cls, folder: str, names: tuple[str, ...] = SCHEMA_NAMES) -> SchemaRegistry:
        """From <name>.schema.json files of a folder on the driver."""
        return cls({n: json.loads(Path(folder, f"{n}.schema.json").read_text(encoding="utf-8")) for n in names})

    def violations(self, name: str, text: Column | str) -> Column:
        """Of a column of JSON texts: an array of "path message", empty if valid, null for null."""
        if name not in self.schemas:
            raise ValueError(f"unknown schema: {name}")
        text = F.col(text) if isinstance(text, str) else text
        # Bound by a lambda, a record is parsed once and not wherever its value is looked at.
        found = lambda v: F.when(v.isNotNull(), violations(v, self.schemas[name])).when(text.isNotNull(), F.array(F.lit("/ must be JSON")))
        return F.get(F.transform(F.array(F.try_parse_json(text)), found), F.lit(0))
