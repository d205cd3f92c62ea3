"""Line dedup by windows of three consecutive lines, in DataFrame functions only.

A line ends at \\n. Each window of three consecutive lines with a word is hashed (128 bits); of a window found at
several places, the first by (id, place) stays and the lines of the others are covered; covered lines go. Windows
may overlap; all are judged on the input. Texts of fewer than three lines have no window and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import renamed

WINDOW = 3


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each window: its hash `h1`, `h2` and its place `__id`, `__row`, `__pos`."""
    df = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__row"), F.split(F.col(f"`{text_col}`"), "\n").alias("__l"))
    df = df.where(F.size("__l") >= WINDOW)
    three = F.transform(F.sequence(F.lit(1), F.size("__l") - (WINDOW - 1)), lambda i: F.slice(F.col("__l"), i, WINDOW))
    df = df.select("__id", "__row", F.posexplode(F.transform(three, lambda w: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"), F.trim(F.translate(F.array_join(w, ""), "\t\x0b\x0c\r", "    ")).alias("t")))).alias("__pos", "w"))
    return df.where(F.col("w.t") != "").select("__id", "__row", "__pos", "w.h1", "w.h2")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`__id`, `__row`, `__at`: the starts of the windows of that document that some earlier place has.

    The hot windows are reduced to their first place before the shuffle; the join back is a plain equi-join, whose
    skewed keys are split at run time.
    """
    occ = occurrences(docs, id_col, text_col)
    place = F.struct("__id", "__row", "__pos")
    first = occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = occ.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, and the long columns `n_lines`, `n_removed`, which replace any of that name.

    A null text stays null and has no lines; a text whose lines all go becomes empty. Null ids come first. Rows that
    repeat id and text are one document, so they don't remove each other's lines. Other columns stay, whatever their
    names; empty tables give no rows; a text may have as many lines as a row can hold.
    """
    df, names = renamed(docs)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    at = covered(df, key, text).select(F.col("__id").alias("__i"), F.col("__row").alias("__r"), "__at")
    keyed = df.withColumn("__row", F.xxhash64(text))
    df = keyed.join(at, keyed[key].eqNullSafe(at["__i"]) & (keyed["__row"] == at["__r"]), "left").drop("__i", "__r", "__row")
    df = df.withColumn("__l", F.split(text, "\n"))
    gone = F.flatten(F.transform("__at", lambda p: F.sequence(p, p + (WINDOW - 1))))
    df = df.withColumn("__k", F.when(F.col("__at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), gone)))
    left = F.array_join(F.transform("__k", lambda i: F.get("__l", i)), "\n")
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c.lower() not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("__l").isNull(), 0).otherwise(F.size("__l")).cast("long")
    n_removed = F.when(F.col("__k").isNull(), 0).otherwise(F.size("__l") - F.size("__k")).cast("long")
    out = F.when(F.col("__k").isNull(), F.col(text)).otherwise(left)
    return df.select(*[out if n == text else F.col(n) for n, _ in kept], n_lines, n_removed).toDF(*[c for _, c in kept], "n_lines", "n_removed")
