"""Checks of dependencies against all rows: X -> A holds if no two rows agree on X and differ in A."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.encoding import check_columns, encode, key, value
from lodestar.operators.cover import bits
from lodestar.plans.scratch import materialize

#: Left-hand sides that one job looks at; each multiplies the rows that enter its aggregation.
BATCH = 32
#: Groups of two rows or more are kept if they hold at most one row of so many; and up to so many of them are broadcast.
SHARE, FEW_GROUPS = 4, 500_000


class Checker:
    """Checks candidates against all rows of a table of codes.

    A left side is checked on the groups of two rows or more of some of its columns (a stripped partition), as only these
    rows can clash: the two columns with most values. Where few rows are in such groups, they are written once, and all
    left sides that hold these columns read them instead of the table, at this level and the next ones. To find them,
    rows are sent as single hashes, for each pair of columns and not for each left side.
    """

    def __init__(self, codes: DataFrame, n_rows: int, nulls: bool = True):
        self.codes, self.n_rows, self.nulls = codes, n_rows, nulls
        self.names = codes.columns
        self.stripped: dict[int, DataFrame | None] = {}
        self.values: dict[int, int] = {}

    def _base(self, x: int) -> int:
        """The two columns of a left side that have most values, as a mask."""
        return sum(1 << k for k in sorted(bits(x), key=lambda k: (-self.values[k], k))[:2])

    def _strip(self, lists: list[int]) -> None:
        """Write the rows that share their values of these column sets with others, where they are few."""
        worth = []
        for y in lists:
            self.stripped[y] = None
            if math.prod(self.values[k] for k in bits(y)) * 2 > self.n_rows:
                worth.append(y)
        for at in range(0, len(worth), BATCH):
            batch = worth[at : at + BATCH]
            spread = F.explode(F.array(*[F.struct(F.lit(j).alias("y"), _key(y, self.nulls)[0].alias("k1")) for j, y in enumerate(batch)])).alias("s")
            groups = self.codes.select(spread).select("s.*").where("k1 is not null").groupBy("y", "k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            groups = materialize(groups, "groups")
            sizes = {r["y"]: (r["rows"], r["groups"]) for r in groups.groupBy("y").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).collect()}
            few = [j for j in range(len(batch)) if sizes.get(j, (0, 0))[0] * SHARE <= self.n_rows]
            total = sum(sizes.get(j, (0, 0))[1] for j in few)
            wanted = groups.where(F.col("y").isin(few)).select("y", "k1")
            wanted = F.broadcast(wanted) if total <= FEW_GROUPS else wanted  # two numbers each
            rows = materialize(self.codes.select("*", spread).select(*self.names, "s.*").join(wanted, ["y", "k1"]).select("y", *self.names), "stripped")
            for j in few:
                self.stripped[batch[j]] = rows.where(F.col("y") == j).drop("y") if j in sizes else rows.limit(0).drop("y")

    def refuted(self, candidates: dict[int, int], witnesses: dict[int, list[tuple[int, int]]] | None = None) -> dict[int, int]:
        """Of candidates (mask of the left side -> mask of right sides): the right sides that don't hold.

        `witnesses`, if given, gets for refuted left sides some clashing groups: a right side and a hash of the key.
        """
        out = dict.fromkeys(candidates, 0)
        if self.n_rows <= 1:
            return out
        if not self.values and any(x.bit_count() > 1 for x in candidates):
            counts = self.codes.agg(*[F.approx_count_distinct(c, 0.1) for c in self.names]).first()
            self.values = {int(c[1:]): counts[k] for k, c in enumerate(self.names)}
        bases = {x: self._base(x) for x in candidates if x.bit_count() > 1}
        self._strip(sorted({y for y in bases.values() if y not in self.stripped}))
        by_table: dict[int, list[int]] = {}
        for x in sorted(candidates):
            by_table.setdefault(bases[x] if x in bases and self.stripped[bases[x]] is not None else -1, []).append(x)
        jobs = [(lists[at : at + BATCH], y) for y, lists in by_table.items() for at in range(0, len(lists), BATCH)]
        few = [(lists, y) for lists, y in jobs if y >= 0]
        for some in ([few[at : at + BATCH] for at in range(0, len(few), BATCH)]) + [[job] for job in jobs if job[1] < 0]:
            rows, batch = [], [x for lists, _ in some for x in lists]
            rights = sorted({a for x in batch for a in bits(candidates[x])})
            for lists, y in some:
                sides = [F.struct(F.lit(batch.index(x)).alias("x"), *[k.alias(f"k{j}") for j, k in enumerate(_key(x, self.nulls), 1)]) for x in lists]
                table = self.codes if y < 0 else self.stripped[y]
                rows.append(table.select(F.explode(F.array(*sides)).alias("s"), *[f"c{a}" for a in rights]).where("s.k1 is not null").select("s.*", *[f"c{a}" for a in rights]))
            for x, bad, groups in _clashes(reduce(DataFrame.unionAll, rows), batch, rights, candidates, self.nulls):
                out[x] |= bad
                if witnesses is not None:
                    witnesses.setdefault(x, []).extend(groups)
        return out


def _key(x: int, nulls: bool) -> tuple[Column, Column]:
    """Two hashes of a row's codes in the columns of a mask; null where one of them is."""
    k1, k2 = key(list(bits(x)))
    for k in bits(x) if nulls else ():
        k1 = F.when(F.col(f"c{k}").isNotNull(), k1)
    return k1, k2


def _clashes(rows: DataFrame, batch: list[int], rights: list[int], candidates: dict[int, int], nulls: bool) -> Iterable[tuple[int, int, set[tuple[int, int]]]]:
    """Each left side with its refuted right sides, and the groups that refute them with the least and the largest key.

    Of rows (number of the left side, key, codes), groups are reduced to the least and largest code of each right side
    before the shuffle, and only one row for each left side comes back. A null code on the right differs from any
    other row's; without null codes (nulls=False) none is looked for.
    """
    aggs = [f(f"c{a}").alias(f"{v}{a}") for a in rights for f, v in ((F.min, "p"), (F.max, "q"))]
    if nulls:
        aggs += [F.count(F.lit(1)).alias("n"), *[F.count(f"c{a}").alias(f"n{a}") for a in rights]]
    clash = lambda a: F.coalesce((F.col(f"p{a}") != F.col(f"q{a}")) | ((F.col(f"n{a}") < F.col("n")) & (F.col("n") > 1) if nulls else F.lit(False)), F.lit(False))
    ends = [f(F.when(clash(a), F.col("k1"))).alias(f"{v}{a}") for a in rights for f, v in ((F.min, "u"), (F.max, "v"))]
    for row in rows.groupBy("x", "k1", "k2").agg(*aggs).groupBy("x").agg(*ends).collect():  # one row for each left side
        x = batch[row["x"]]
        bad = sum(1 << a for a in rights if row[f"u{a}"] is not None) & candidates[x]
        yield x, bad, {(a, row[f"{v}{a}"]) for a in bits(bad) for v in "uv"}


def refuted(codes: DataFrame, candidates: dict[int, int], n_rows: int, nulls: bool = True) -> dict[int, int]:
    """Of candidates (mask of the left side -> mask of right sides): the right sides that don't hold."""
    return Checker(codes, n_rows, nulls).refuted(candidates)


def check_fd(df: DataFrame, lhs: Sequence[str], rhs: str, null_equals_null: bool = True, compare_as_string: bool = False) -> bool:
    """Whether lhs -> rhs holds; lhs may be empty. Stops at the first clash that a task finds."""
    return violations(df, lhs, rhs, null_equals_null, compare_as_string).isEmpty()


def violations(df: DataFrame, lhs: Sequence[str], rhs: str, null_equals_null: bool = True, compare_as_string: bool = False) -> DataFrame:
    """The groups that refute lhs -> rhs: values of lhs, `n_rows`, and two values of rhs that clash (`rhs_low`, `rhs_high`).

    Where one of the two is null, it is `rhs_low`. Without equal nulls, a group may clash by its nulls alone.
    """
    lhs, rhs = check_columns(df, lhs), check_columns(df, [rhs])[0]
    if rhs in lhs:
        raise ValueError(f"{rhs!r} is on both sides")
    rows = df.select(*[value(df, c, compare_as_string).alias(c) for c in lhs], value(df, rhs, compare_as_string).alias("__r"))
    if not null_equals_null:
        for c in lhs:
            rows = rows.where(F.col(f"`{c}`").isNotNull())
    groups = rows.groupBy(*[F.col(f"`{c}`") for c in lhs]).agg(F.count(F.lit(1)).alias("n_rows"), F.count("__r").alias("__n"), F.min("__r").alias("__p"), F.max("__r").alias("__q"))
    nulls = F.col("__n") < F.col("n_rows")
    clash = (F.col("__p") != F.col("__q")) | (nulls & (F.col("__n") > 0)) | (F.lit(not null_equals_null) & nulls & (F.col("n_rows") > 1))
    return groups.where(F.coalesce(clash, F.lit(not null_equals_null) & nulls & (F.col("n_rows") > 1), F.lit(False))).select(*[F.col(f"`{c}`") for c in lhs], "n_rows", F.when(~nulls, F.col("__p")).alias("rhs_low"), F.col("__q").alias("rhs_high"))


def validate(df: DataFrame, candidates: Iterable[tuple[Sequence[str], str]], null_equals_null: bool = True, compare_as_string: bool = False) -> DataFrame:
    """`lhs` (array), `rhs`, `holds` for each candidate, with one job for each batch of left sides."""
    names, spark = df.columns, df.sparkSession
    wanted = [(check_columns(df, x), check_columns(df, [a])[0]) for x, a in candidates]
    codes = encode(df, names, null_equals_null, compare_as_string)
    masks: dict[int, int] = {}
    for x, a in wanted:
        m = sum(1 << names.index(c) for c in x)
        masks[m] = masks.get(m, 0) | 1 << names.index(a)
    bad = refuted(codes, masks, codes.count(), not null_equals_null)
    rows = [(x, a, not bad[sum(1 << names.index(c) for c in x)] >> names.index(a) & 1) for x, a in wanted]
    return spark.createDataFrame(rows, "lhs array<string>, rhs string, holds boolean")


def witness_masks(codes: DataFrame, witnesses: dict[int, list[tuple[int, int]]], n: int) -> set[int]:
    """What pairs of rows that clash agree on: of each group in `witnesses`, the rows at both ends of the right side.

    The groups are two for each refuted candidate at most, so they are sent to all tasks; one scan finds the rows.
    """
    from lodestar.functions.encoding import agree_mask, mask_of

    lists = sorted(x for x, groups in witnesses.items() if groups)
    out: set[int] = set()
    everything = F.struct(*[F.col(f"c{k}") for k in range(n)])
    for at in range(0, len(lists), BATCH):
        batch = lists[at : at + BATCH]
        wanted = codes.sparkSession.createDataFrame([(j, k1, a) for j, x in enumerate(batch) for a, k1 in witnesses[x]], "x int, k1 long, a int")
        sides = [codes.select(everything.alias("row"), F.lit(j).alias("x"), key(list(bits(x)))[0].alias("k1")) for j, x in enumerate(batch)]
        rows = reduce(DataFrame.unionAll, sides).join(F.broadcast(wanted), ["x", "k1"])
        order = F.coalesce(F.get(F.array(*[F.col(f"row.c{k}") for k in range(n)]), F.col("a")), F.lit(0))
        pairs = rows.groupBy("x", "k1", "a").agg(F.min_by("row", order).alias("l"), F.max_by("row", order).alias("r"))
        out |= {mask_of(r[0]) for r in pairs.select(agree_mask("l.", "r.", n).alias("mask")).distinct().collect()}  # sets of columns
    return out
