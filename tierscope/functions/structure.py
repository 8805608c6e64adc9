"""JSON trees: canonical form and keys, sanitising and page texts."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .core import bound_batches

# Keys that can tell where a document came from.
LOCATION_KEYS = ("filename", "file_path", "filepath", "origin", "path", "source_url", "sourceurl", "uri", "url")


# The collation order of white space and ASCII punctuation; digits and letters follow.
_MARKS = "\t\n\x0b\x0c\r  _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).rstrip("0")
    if not digits:
        return "0"
    point = len(Decimal(repr(x)).as_tuple().digits) + exponent
    if point > 21 or point <= -6:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    elif point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits.ljust(point, "0")
        out = out[:point] + ("." + out[point:] if len(out) > point else "")
    return "-" * sign + out


def _collated(key: str) -> tuple:
    """Marks before digits before letters; letters by themselves first, then by their accents, then the small one before the
    capital. Right for Latin letters; column functions take any key's order from the engine's collation instead."""
    split = unicodedata.normalize("NFD", key)
    plain = [c for c in split if not unicodedata.combining(c)]
    return [(0, _MARKS.find(c), "") if c in _MARKS else (1, 0, c) if c.isdigit() else (2, 0, c.lower()) for c in plain], [c for c in split if unicodedata.combining(c)], [c.isupper() for c in plain], key


def stringify(value: object, sort: bool = False, order: dict[str, int] | None = None) -> str:
    """JSON without spaces and with ECMAScript's numbers, which are doubles; keys as they come, or in collation order, by
    their given places where order has them."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return str(value) if isinstance(value, int) and abs(value) <= 2**53 else _number(float(value) if abs(value) < 2**1024 else float("inf"))
    if isinstance(value, dict):
        keys = (sorted(value, key=_collated) if order is None else sorted(value, key=order.__getitem__)) if sort else value
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stringify(value[k], sort, order)}" for k in keys) + "}"
    return "[" + ",".join(stringify(x, sort, order) for x in value) + "]"


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces, numbers as ECMAScript writes them."""
    return stringify(value, sort=True)


def _keys(value: object) -> set[str]:
    """The keys of all objects in a tree."""
    if isinstance(value, list):
        return set().union(*map(_keys, value))
    return set(value).union(*map(_keys, value.values())) if isinstance(value, dict) else set()


@F.pandas_udf(ArrayType(StringType()))
def _keys_of(tree: pd.Series) -> pd.Series:
    return tree.map(lambda t: None if t is None else sorted(_keys(json.loads(t))))


@F.pandas_udf(StringType())
def _written(tree: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else stringify(json.loads(t), True, {k: i for i, k in enumerate(ks)}) for t, ks in zip(tree, keys, strict=True)], dtype=object)


def canonical(tree: Column | str) -> Column:
    """canonical_json of JSON texts, the keys of each text ordered by the engine's Unicode collation, which no table here has to
    know; keys that it holds for equal are ordered by code points."""
    bound_batches()
    tree = F.col(tree) if isinstance(tree, str) else tree
    ordered = F.transform(F.array_sort(F.transform(_keys_of(tree), lambda k: F.struct(F.collate(k, "UNICODE").alias("c"), k.alias("k")))), lambda x: x["k"])
    return _written(tree, ordered)


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def artifact_key(content_hash: str, provider_id: str, version: str, model: str | None, parameters: dict) -> str:
    """The key of an extraction: content, provider, version, model and hashed parameters, not where it ran."""
    own = sha256_text(canonical_json(parameters))
    return sha256_text(canonical_json({"contentHash": content_hash, "model": model, "parametersHash": own, "providerId": provider_id, "providerVersion": version}))


def artifact_key_column(content_hash: Column, provider_id: Column, version: Column, model: Column, parameters: Column) -> Column:
    """artifact_key of columns; parameters is canonical JSON already."""
    def quoted(c: Column) -> Column:
        whole = F.to_json(F.struct(c.alias("x")))  # {"x":"..."}
        return F.when(c.isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))

    return F.sha2(F.concat(F.lit('{"contentHash":'), quoted(content_hash), F.lit(',"model":'), quoted(model), F.lit(',"parametersHash":"'), F.sha2(parameters, 256), F.lit('","providerId":'), quoted(provider_id), F.lit(',"providerVersion":'), quoted(version), F.lit("}")), 256)


def source_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero character between them."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def sanitise(value: object) -> object:
    """The tree without keys that name locations, whatever their case."""
    if isinstance(value, list):
        return [sanitise(x) for x in value]
    if isinstance(value, dict):
        return {k: sanitise(x) for k, x in value.items() if k.lower() not in LOCATION_KEYS}
    return value


@F.pandas_udf(StringType())
def sanitised(tree: pd.Series) -> pd.Series:
    return tree.map(lambda t: None if t is None else canonical_json(sanitise(json.loads(t))))


def page_texts(items: DataFrame, key: str = "case_id", pages: str = "pages", text: str = "text", order: str = "ord") -> DataFrame:
    """(key, page, text): each page's non-blank items in order, an empty line between them."""
    shown = items.where(F.trim(text) != "").withColumn("page", F.explode(F.array_distinct(pages)))
    return shown.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("text"))


def derived_pages(documents: DataFrame, texts: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, page, text) for pages 1 to page_count, '' where there is no text."""
    every = documents.where("page_count > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return every.join(texts, [key, "page"], "left").select(key, "page", F.coalesce("text", F.lit("")).alias("text"))
