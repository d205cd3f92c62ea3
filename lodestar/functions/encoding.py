"""Codes: one 64-bit number for each value, in which all later comparisons are made.

A code is a hash of the typed value, so encoding is a projection without a shuffle. Under the policy that nulls are
equal, null has a code of its own; else its code stays null, which agrees with nothing. Groups are keyed by two
hashes of their codes (128 bits).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The code of null, where nulls are equal.
NULL_CODE = 0x6E756C6C5F636F64
#: Columns for each number of a mask.
WORD = 62


def _groupable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _groupable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_groupable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def value(df: DataFrame, name: str, compare_as_string: bool = False) -> Column:
    """A column in the form in which its values are compared."""
    column, kind = df[f"`{name}`"], df.schema[name].dataType
    if compare_as_string and not isinstance(kind, T.StringType):
        return F.to_json(column) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else column.cast("string")
    if not _groupable(kind):
        raise ValueError(f"column {name!r} of type {kind.simpleString()} can't be grouped; use compare_as_string")
    return column


def check_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names must differ")
    return list(names)


def encode(df: DataFrame, names: Sequence[str] | None = None, null_equals_null: bool = True, compare_as_string: bool = False) -> DataFrame:
    """The codes of the named columns (all by default), as `c0`, `c1`, ..., with no other column."""
    names = check_columns(df, df.columns if names is None else names)
    out = []
    for k, name in enumerate(names):
        v = value(df, name, compare_as_string)
        nothing = F.lit(NULL_CODE) if null_equals_null else F.lit(None).cast("long")
        out.append(F.when(v.isNull(), nothing).otherwise(F.xxhash64(v)).alias(f"c{k}"))
    return df.select(*out)


def key(columns: Sequence[int]) -> tuple[Column, Column]:
    """Two hashes of the codes of a set of columns."""
    codes = [F.col(f"c{k}") for k in columns]
    return F.xxhash64(F.lit(1), *codes), F.xxhash64(F.lit(2), *codes)


def agree_mask(left: str, right: str, n: int) -> Column:
    """Of two rows of codes: an array of numbers whose bits say in which columns they agree."""
    words = []
    for at in range(0, max(n, 1), WORD):
        bits = [F.when(F.col(f"{left}c{k}") == F.col(f"{right}c{k}"), F.lit(1 << (k - at)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(at, min(n, at + WORD))]
        words.append(sum(bits[1:], bits[0]) if bits else F.lit(0).cast("long"))
    return F.array(*words)


def mask_of(words: Sequence[int]) -> int:
    """A mask's array as one number."""
    return sum(w << (WORD * k) for k, w in enumerate(words))
