"""Edit distances as column expressions, and edit scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Letters of one machine word; a sum of two words does not overflow.
_WORD = 62


def indel_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions only (a replacement costs two).

    |a| + |b| less twice the longest common subsequence, which is found bit by
    bit: a word holds 62 letters of ``b``, and each letter of ``a`` costs one
    addition for each word.
    """
    n = F.length(b)
    words = F.sequence(F.lit(0), F.floor((n - 1) / _WORD).cast("int"))
    full = (1 << _WORD) - 1

    def masks(chars: Column, c: Column) -> Column:
        """For each word the bits of the places of ``c``."""
        places = lambda w: F.sequence(F.lit(0), F.least(F.lit(_WORD - 1), n - 1 - w * _WORD))
        return F.transform(words, lambda w: F.aggregate(places(w), F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.when(F.get(chars, w * _WORD + k) == c, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))))

    def step(v: Column, m: Column) -> Column:
        def add(s: Column, w: Column) -> Column:
            old, bits = F.get(v, w), F.get(m, w)
            total = old + old.bitwiseAND(bits) + s["carry"]
            new = total.bitwiseAND(F.lit(full)).bitwiseOR(old.bitwiseAND(F.bitwise_not(bits)))
            return F.struct(F.array_append(s["v"], new).alias("v"), F.call_function("shiftrightunsigned", total, F.lit(_WORD)).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("v"), F.lit(0).cast("long").alias("carry"))
        return F.when(m.isNull(), v).otherwise(F.aggregate(words, start, add, lambda s: s["v"]))

    def fold(chars: Column) -> Column:
        unlike = F.array_distinct(chars)
        tables = F.array(F.map_from_arrays(unlike, F.transform(unlike, lambda c: masks(chars, c))))  # a variable: made once
        ones = F.transform(words, lambda w: F.lit(full))
        left = lambda v: F.aggregate(v, F.lit(0), lambda k, x: k + F.bit_count(x))
        found = F.transform(tables, lambda table: F.aggregate(letters(a), ones, lambda v, c: step(v, F.try_element_at(table, c)), left))
        common = _WORD * F.size(words) - F.get(found, F.lit(0))
        return F.length(a) + n - 2 * common

    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    folded = F.get(F.transform(F.array(letters(b)), fold), F.lit(0)).cast("int")
    return F.when(a == b, F.lit(0)).when(F.length(a) == 0, n).when(n == 0, F.length(a)).otherwise(folded)


def edit_distance(a: Column, b: Column, *, replace_cost_two: bool = False) -> Column:
    return indel_distance(a, b) if replace_cost_two else F.levenshtein(a, b)


def distance_confidence(query: Column, text: Column) -> Column:
    """1 - distance / length of the query; 1 for equal texts; negative if the distance is longer than the query."""
    d = indel_distance(query, text)
    return F.when(d == 0, F.lit(1.0)).otherwise(1 - d / F.length(query))


OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("source", T.IntegerType()), T.StructField("target", T.IntegerType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("s_begin", T.IntegerType()), T.StructField("s_end", T.IntegerType()), T.StructField("t_begin", T.IntegerType()), T.StructField("t_end", T.IntegerType())]))
MATCHES = T.ArrayType(T.StructType([T.StructField("source", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def script(a: str, b: str) -> list[tuple[str, int, int]]:
    """One optimal edit script (insert, delete, replace), in order."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, last = [i], rows[-1]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        here = rows[i][j]
        if i and j and a[i - 1] == b[j - 1] and rows[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
        elif i and j and rows[i - 1][j - 1] + 1 == here:
            i, j = i - 1, j - 1
            out.append(("replace", i, j))
        elif j and rows[i][j - 1] + 1 == here:
            j -= 1
            out.append(("insert", i, j))
        else:
            i -= 1
            out.append(("delete", i, j))
    return out[::-1]


def blocks(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """The script as maximal blocks that cover both texts, ``equal`` ones included."""
    out: list[list] = []

    def put(op: str, s0: int, s1: int, t0: int, t1: int) -> None:
        if out and out[-1][0] == op and out[-1][2] == s0 and out[-1][4] == t0:
            out[-1][2], out[-1][4] = s1, t1
        else:
            out.append([op, s0, s1, t0, t1])

    i = j = 0
    for op, s, t in [*script(a, b), ("end", len(a), len(b))]:
        if s > i:
            put("equal", i, s, j, t)
        i, j = s, t
        if op != "end":
            s1, t1 = s + (op != "insert"), t + (op != "delete")
            put(op, s, s1, t, t1)
            i, j = s1, t1
    return [tuple(x) for x in out]


def _each(of, kind):
    """``of`` for each row; a pair of texts that a batch holds again is not computed again."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            rows = list(zip(a, b, strict=True))
            known = {(x, y): None if x is None or y is None else of(x, y) for x, y in set(rows)}
            yield pd.Series([known[row] for row in rows], dtype=object)

    return run


def edit_ops(a: Column, b: Column) -> Column:
    return _each(script, OPS)(a, b)


def edit_blocks(a: Column, b: Column) -> Column:
    return _each(blocks, BLOCKS)(a, b)


def _matches(a: str, b: str) -> list[tuple[int, int, int]]:
    return [(s0, t0, s1 - s0) for op, s0, s1, t0, _ in blocks(a, b) if op == "equal"]


def matching_blocks(a: Column, b: Column) -> Column:
    return _each(_matches, MATCHES)(a, b)
