"""All minimal functional dependencies of a relation."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.encoding import check_columns, encode
from lodestar.operators import agree
from lodestar.operators.cover import Cover, bits, induced, maximal
from lodestar.operators.validate import Checker, witness_masks
from lodestar.plans.scratch import materialize

log = logging.getLogger("lodestar")

METHODS = ("hybrid", "pairs", "lattice")
#: Refuted candidates of a level up to which the search goes on without more samples.
SWITCH = 8
#: Columns up to which the lattice of all column sets may be spelled out.
LATTICE_COLUMNS = 12


@dataclass(frozen=True)
class Config:
    """What a run can be told; a wrong name or value is a ValueError."""

    null_equals_null: bool = True
    max_lhs: int | None = None
    row_limit: int | None = None
    method: str = "hybrid"
    compare_as_string: bool = False
    candidate_budget: int | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("max_lhs", "row_limit", "candidate_budget"):
            v = getattr(self, name)
            if v is not None and (not isinstance(v, int) or isinstance(v, bool)):
                raise ValueError(f"{name} must be a whole number or None, not {v!r}")
        for name in ("null_equals_null", "compare_as_string"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")

    @classmethod
    def of(cls, **options) -> Config:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**options)

    @classmethod
    def requirements(cls) -> dict[str, object]:
        """All options with their defaults."""
        return {f.name: f.default for f in fields(cls)}

    @property
    def limit(self) -> int | None:
        """The largest left-hand side; a negative number is no limit, and 0 leaves the empty one."""
        return None if self.max_lhs is None or self.max_lhs < 0 else self.max_lhs


def limited(df: DataFrame, rows: int | None, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows, in the order of some columns if given; all of them without a positive number."""
    if rows is None or rows <= 0:
        return df
    return (df.orderBy(*[df[f"`{c}`"] for c in check_columns(df, order_by)]) if order_by else df).limit(rows)


def minimal_cover(df: DataFrame, config: Config) -> Cover:
    """The minimal dependencies as masks over df's columns."""
    n = len(check_columns(df, df.columns))
    codes = materialize(encode(limited(df, config.row_limit, config.order_by), None, config.null_equals_null, config.compare_as_string), "codes")
    rows = codes.count() if n else 0
    log.info("%d columns, %d rows, method %s", n, rows, config.method)
    if rows <= 1:
        return induced(n, [], config.limit, config.candidate_budget)
    return {"pairs": _by_pairs, "lattice": _by_lattice, "hybrid": _by_levels}[config.method](codes, n, rows, config)


def _by_pairs(codes: DataFrame, n: int, rows: int, config: Config) -> Cover:
    return induced(n, maximal_needed(agree.masks(agree.all_pairs(codes)), n), config.limit, config.candidate_budget)


def maximal_needed(masks: set[int], n: int) -> set[int]:
    """Agree sets that matter: for some column outside them, no larger one lacks that column, too."""
    out: set[int] = set()
    for rhs in range(n):
        out |= maximal(m for m in masks if not m >> rhs & 1)
    return out


def _by_lattice(codes: DataFrame, n: int, rows: int, config: Config) -> Cover:
    """From the number of groups of each column set: X -> A holds if X and X with A have as many."""
    if n > LATTICE_COLUMNS:
        raise ValueError(f"{n} columns are too many for a lattice; the limit is {LATTICE_COLUMNS}")
    names = [f"c{k}" for k in range(n)]
    if not config.null_equals_null:  # each null is a value of its own
        numbers = agree.numbered(codes)
        codes = numbers.select(*[F.coalesce(F.col(c), F.xxhash64(F.lit(c), F.col("id"))).alias(c) for c in names])
    present = sum(((1 - F.grouping(c).cast("long")) * (1 << k) for k, c in enumerate(names)), F.lit(0).cast("long"))
    groups = codes.cube(*names).agg(present.alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    size = {r["m"]: r["n"] for r in groups.collect()}  # a row for each column set
    cover = Cover(n, config.limit, config.candidate_budget)
    for x in sorted(size, key=int.bit_count):
        for a in range(n):
            if not x >> a & 1 and size[x] == size[x | 1 << a]:
                cover.add_unless_implied(x, a)
    return cover


def _by_levels(codes: DataFrame, n: int, rows: int, config: Config) -> Cover:
    """Compare neighbours in clusters, induce candidates, and check them against all rows, level by level.

    Where a level refutes more candidates than it confirms, and more than the level before it, clashing pairs of rows are
    looked up, the sampler is resumed, and what both show refutes candidates of the levels to come.
    """
    sampler = agree.Sampler(codes, rows)
    cover = induced(n, maximal_needed(sampler.run(), n), config.limit, config.candidate_budget)
    checker = Checker(codes, rows, not config.null_equals_null)
    done: set[tuple[int, int]] = set()
    level = before = 0
    while level <= min(cover.depth, n) and (config.limit is None or level <= config.limit):
        open_ = {x: sum(1 << a for a in bits(rights) if (x, a) not in done) for x, rights in cover.level(level).items()}
        open_ = {x: rights for x, rights in open_.items() if rights}
        witnesses: dict[int, list[tuple[int, int]]] = {}
        bad = checker.refuted(open_, witnesses) if open_ else {}
        done |= {(x, a) for x, rights in open_.items() for a in bits(rights & ~bad.get(x, 0))}
        wrong = [(x, a) for x, rights in bad.items() for a in bits(rights)]
        right = sum(r.bit_count() for r in open_.values()) - len(wrong)
        log.info("level %d: %d candidates, %d refuted", level, right + len(wrong), len(wrong))
        for x, a in wrong:
            cover.remove(x, a)
        for x, a in wrong:
            for b in range(n):
                new = cover.extend(x, a, b)
                if new is not None:
                    cover.add(new, a)
        if len(wrong) > max(SWITCH, right) and len(wrong) > before and cover.depth > level:
            cover.induce(maximal_needed(witness_masks(codes, witnesses, n) | sampler.run(), n))
        level, before = level + 1, len(wrong)
    return cover


def discover(df: DataFrame, table: str | None = None, receiver: Callable[[tuple[str, ...], str], None] | None = None, **options) -> DataFrame:
    """`lhs` (array, in schema order), `rhs`, and `table` if named: every minimal, non-trivial dependency of df.

    Options are those of Config. A receiver, if given, is called once for each dependency. A relation of no or one row
    gives {} -> A for each column A. The result doesn't depend on the method.
    """
    config = Config.of(**options)
    names = df.columns
    cover = minimal_cover(df, config)
    found = sorted(([names[k] for k in bits(x)], names[a]) for x, a in cover)
    if receiver is not None:
        for x, a in found:
            receiver(tuple(x), a)
    out = df.sparkSession.createDataFrame(found, "lhs array<string>, rhs string")
    return out.withColumn("table", F.lit(table)) if table is not None else out


def non_dependencies(df: DataFrame, null_equals_null: bool = True, compare_as_string: bool = False) -> DataFrame:
    """`lhs`, `rhs`: the largest sets that don't determine a column. They follow from the minimal dependencies.

    A set doesn't determine A if it holds none of A's minimal left-hand sides, so the largest such sets are the
    complements of the smallest that hit each of those.
    """
    names = df.columns
    cover = minimal_cover(df, Config(null_equals_null=null_equals_null, compare_as_string=compare_as_string))
    found = []
    for a, lists in enumerate(cover.sets):
        everything = ((1 << len(names)) - 1) & ~(1 << a)
        hitting = {0}
        for x in lists:
            hitting = {h | 1 << b for h in hitting for b in bits(x) if not h & x} | {h for h in hitting if h & x}
            hitting = {h for h in hitting if not any(o != h and o & ~h == 0 for o in hitting)}
        if 0 not in lists:
            found += [([names[k] for k in bits(everything & ~h)], names[a]) for h in hitting]
    return df.sparkSession.createDataFrame(sorted(found), "lhs array<string>, rhs string")
