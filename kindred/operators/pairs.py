"""Pairs of rows within groups, compared by their texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured_pairs(rows: DataFrame, by: list[str], key: str, text: str, measure: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """(a_key, b_key, *measures) of all pairs of a group with a_key < b_key.

    Rows of a group that share a text are one class; two classes are measured once, a class with itself included,
    in both orders of the texts if both occur, and then expanded to all pairs of their keys, without a shuffle.
    """
    classes = rows.groupBy(*by, text).agg(F.collect_list(key).alias("keys")).filter(F.size("keys") > 0)
    side = lambda s: classes.select(*by, F.col(text).alias(f"{s}_text"), F.col("keys").alias(f"{s}_keys"))
    met = side("a").join(side("b"), by).filter(F.array_min("a_keys") < F.array_max("b_keys"))
    measures = measure(F.col("a_text"), F.col("b_text"))
    met = met.select("a_keys", "b_keys", *(c.alias(name) for name, c in measures.items()))
    each = met.select(F.explode("a_keys").alias("a_key"), "b_keys", *measures).select("a_key", F.explode("b_keys").alias("b_key"), *measures)
    return each.filter("a_key < b_key")
