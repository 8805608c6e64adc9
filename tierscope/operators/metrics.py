"""Structure matching, chunking and boundary metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import metric, ratio_value
from .graphs import matched_by_component
from .similarity import alike, text_classes


def _sides(reference: DataFrame, output: DataFrame, key: str) -> list[DataFrame]:
    return [text_classes(side, [key, "type"], "idx", "text") for side in (reference, output)]


def similar_elements(reference: DataFrame, output: DataFrame, threshold: float = 0.9, key: str = "doc_id") -> DataFrame:
    """(key, ref_idx, out_idx, similarity) of pairs of one type that are alike enough. Different texts are compared once,
    and only those that have a piece in common."""
    by = [key, "type"]
    r, o = _sides(reference, output, key)
    found = alike(r, o, by, threshold)
    named = []
    for side, classes, rep, idx in ((reference, r, "left_rep", "ref_idx"), (output, o, "right_rep", "out_idx")):
        named.append(side.select(*by, F.col("idx").alias(idx), "text").join(classes.select(*by, "text", F.col("rep").alias(rep)).hint("merge"), [*by, "text"]).drop("text"))
    return found.join(named[0].hint("merge"), [*by, "left_rep"]).join(named[1].hint("merge"), [*by, "right_rep"]).select(key, "ref_idx", "out_idx", "similarity")


def structure_metrics(reference: DataFrame, output: DataFrame, threshold: float = 0.9, complete: bool = True, key: str = "doc_id") -> DataFrame:
    """By document: matched, spurious and missed elements, precision, recall and F1 as metric values.

    complete False: the reference covers a part, so spurious elements, precision and F1 are withheld. Elements of
    equal text stand for one node that is matched as often as there are of them; idx is a number that is unique in a document's side.
    """
    r, o = _sides(reference, output, key)
    copies = [side.select(key, "type", F.col("rep").alias(f"{name}_rep"), F.col("copies").alias(f"n_{name}")) for side, name in ((r, "left"), (o, "right"))]
    pairs = alike(r, o, [key, "type"], threshold).join(copies[0].hint("merge"), [key, "type", "left_rep"]).join(copies[1].hint("merge"), [key, "type", "right_rep"])
    edges = pairs.select(key, F.col("left_rep").cast("long").alias("left_id"), F.col("right_rep").cast("long").alias("right_id"), "n_left", "n_right")
    matched = matched_by_component(edges, key).withColumnRenamed("matched", "true_positives")
    sizes = reference.groupBy(key).agg(F.count("*").alias("n_ref")).join(output.groupBy(key).agg(F.count("*").alias("n_out")), key, "full").na.fill(0, ["n_ref", "n_out"])
    out = sizes.join(matched, key, "left").na.fill(0, ["true_positives"])
    tp, n_ref, n_out = F.col("true_positives"), F.col("n_ref"), F.col("n_out")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"false_positives": n_out - tp if complete else F.lit(None).cast("long"), "false_negatives": n_ref - tp, "recall": metric(tp, n_ref)})
    if complete:
        return out.withColumns({"precision": metric(tp, n_out), "f1": metric(2 * tp, n_ref + n_out)})
    return out.withColumns({"precision": metric(zero, zero, n_out), "f1": metric(zero, zero, n_ref + n_out)})


def fixed_chunks(elements: DataFrame, cap: int, key: str = "doc_id") -> DataFrame:
    """First and last chunk of each element when tokens are cut every cap of them. elements: key, id,
    reading_order, pos (breaks ties), tokens."""
    if cap < 1:
        raise ValueError("the cap must be positive")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(key).orderBy("reading_order", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.withColumn("first_chunk", F.floor(before / cap).cast("long")).withColumn("last_chunk", F.floor((before + F.greatest("tokens", F.lit(1)) - 1) / cap).cast("long"))


def structural_chunks(elements: DataFrame, cap: int, key: str = "doc_id") -> DataFrame:
    """(key, id, chunk): a chunk ends before an element that a break precedes, or that would overfill it.

    elements: key, id, reading_order, pos, tokens, breaks (whether a break lies before it). State resets at each chunk, so
    the sorted rows of a document go by once, with three numbers held, however many elements it has.
    """
    if cap < 1:
        raise ValueError("the cap must be positive")
    kinds = {f.name: f.dataType.simpleString() for f in elements.schema.fields}
    rows = elements.repartition(key).sortWithinPartitions(key, "reading_order", "pos").select(F.col(key).alias("key_"), "id", F.col("tokens").cast("long").alias("tokens"), F.coalesce("breaks", F.lit(False)).alias("breaks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk, used = object(), 0, 0
        for frame in frames:
            chunks = []
            for k, tokens, breaks in zip(frame["key_"], frame["tokens"], frame["breaks"], strict=True):
                if k != last:
                    last, chunk, used = k, 0, tokens
                elif breaks or used + tokens > cap:
                    chunk, used = chunk + 1, tokens
                else:
                    used += tokens
                chunks.append(chunk)
            yield pd.DataFrame({key: frame["key_"], "id": frame["id"], "chunk": chunks})

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, id {kinds['id']}, chunk long")


def breaks_before(elements: DataFrame, boundaries: DataFrame, key: str = "doc_id") -> DataFrame:
    """elements with breaks: whether the boundary between an element and the one before it expects a break."""
    w = Window.partitionBy(key).orderBy("reading_order", "pos")
    b = boundaries.where("expected_action = 'break'").select(key, F.col("before_element_id").alias("prev_"), F.col("after_element_id").alias("id"), F.lit(True).alias("breaks")).distinct()
    return elements.withColumn("prev_", F.lag("id").over(w)).join(b, [key, "prev_", "id"], "left").drop("prev_").na.fill(False, ["breaks"])


def boundary_metrics(boundaries: DataFrame, chunks: DataFrame, key: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """Joins that a chunk border splits, breaks that none marks, and both per 100 opportunities; opportunities
    with an unknown element are excluded by kind. chunks: key, id, first_chunk, last_chunk."""
    a = chunks.select(key, F.col("id").alias("before_element_id"), F.col("last_chunk").alias("b_chunk"))
    b = chunks.select(key, F.col("id").alias("after_element_id"), F.col("first_chunk").alias("a_chunk"))
    rows = boundaries.join(a, [key, "before_element_id"], "left").join(b, [key, "after_element_id"], "left")
    known = F.col("b_chunk").isNotNull() & F.col("a_chunk").isNotNull()
    join, same = F.col("expected_action") == "join", F.col("b_chunk") == F.col("a_chunk")
    out = rows.groupBy(*(by or [])).agg(
        F.count_if(known & join).alias("joins"), F.count_if(known & ~join).alias("breaks"), F.count_if(~known & join).alias("excluded_joins"), F.count_if(~known & ~join).alias("excluded_breaks"),
        F.count_if(known & join & ~same).alias("splits"), F.count_if(known & ~join & same).alias("merges"))
    c = F.col
    return out.withColumns({
        "split_rate": ratio_value(c("splits"), c("joins"), c("excluded_joins")),
        "merge_rate": ratio_value(c("merges"), c("breaks"), c("excluded_breaks")),
        "violations_per_100": ratio_value((c("splits") + c("merges")) * 100, c("joins") + c("breaks"), c("excluded_joins") + c("excluded_breaks")),
    })
