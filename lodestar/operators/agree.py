"""Agree sets: in which columns pairs of rows agree. Each is a mask of columns, as an array of numbers.

`all_pairs` is exact; the others look at some pairs only, in one order or another, and their results
are never more than hints. Input is a table of codes (c0, c1, ...); a null code agrees with nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestar.functions.encoding import WORD, agree_mask, mask_of
from lodestar.operators.cover import bits
from lodestar.plans.scratch import materialize

#: Columns with repeats up to which agreeing pairs are counted by column set, and sets that one job groups by.
COUNTED_COLUMNS, COUNTED_SETS = 12, 64
#: Rows of one value that a window task holds; larger clusters are divided in their order.
CLUSTER_ROWS = 100_000
#: Parts of a cluster whose ends are found before the cluster's own.
END_PARTS = 64
#: Rows for each column whose neighbours a sampler compares, and the least number of clusters that it takes them from.
SAMPLE_ROWS, SAMPLE_CLUSTERS = 20_000, 50
#: Distances at which a sampler compares the rows of a cluster, round by round.
ROUNDS = ((1,), (2,), (3, 4), (5, 6, 7, 8), tuple(range(9, 17)), tuple(range(17, 33)))


def width(codes: DataFrame) -> int:
    return sum(c.startswith("c") and c[1:].isdigit() for c in codes.columns)


def masks(df: DataFrame) -> set[int]:
    """The distinct masks of a table, on the driver: metadata, at most one for each set of columns."""
    return {mask_of(r[0]) for r in df.select("mask").distinct().collect()}


def numbered(codes: DataFrame) -> DataFrame:
    """codes with `id`, unique and fixed; the table is written, as numbers would change when a task runs again."""
    return materialize(codes.withColumn("id", F.monotonically_increasing_id()), "rows")


def _sides(codes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    return tuple(codes.select(F.col("id").alias(f"{v}id"), *[F.col(f"c{k}").alias(f"{v}c{k}") for k in range(n)]) for v in ("l", "r"))


def all_pairs(codes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """`mask`: the agree set of every pair of rows, without repeats. More than `max_rows` rows, if given, are an error.

    A column without repeats is in no agree set, one of a single value in all. Of the others, pairs that agree on at least
    a column set are counted from the sizes of its groups, and from these counts, by inclusion and exclusion, the pairs that
    agree on exactly that set. So no pair is spelled out, and the work is that of 2^columns groupings. Where these are more
    than the rows, or the columns more than COUNTED_COLUMNS, pairs are joined instead, which is quadratic in the rows.
    """
    n = width(codes)
    names = [f"c{k}" for k in range(n)]
    count = codes.count()
    if max_rows is not None and count > max_rows:
        raise ValueError(f"{count} rows are too many to compare each pair; the limit is {max_rows}")
    if not n or count < 2:
        return codes.sparkSession.createDataFrame([], "mask array<bigint>")
    total = count * (count - 1) // 2
    values = codes.select(F.posexplode(F.array(*names)).alias("m", "code")).where("code is not null").groupBy("m", "code").agg(F.count(F.lit(1)).alias("n"))
    single = _agreeing(values)
    some = [k for k in range(n) if 0 < single.get(k, 0) < total]
    always = sum(1 << k for k in range(n) if single.get(k, 0) == total)
    if len(some) > COUNTED_COLUMNS or 1 << len(some) > count:
        return _joined(codes, n, some, always, total)
    rows = codes.groupBy(*[names[k] for k in some]).agg(F.count(F.lit(1)).alias("n")) if some else None
    exactly = [total] + [0] * ((1 << len(some)) - 1)
    for j, k in enumerate(some):
        exactly[1 << j] = single[k]
    sets = [x for x in sorted(range(1 << len(some)), key=int.bit_count) if x.bit_count() > 1]
    if len(sets) > COUNTED_SETS:
        rows = materialize(rows, "counted")
    for at in range(0, len(sets), COUNTED_SETS):
        batch = sets[at : at + COUNTED_SETS]
        batch = [x for x in batch if all(exactly[y] or y in batch for y in (x & ~(1 << j) for j in bits(x)))]
        if not batch:
            continue
        mark = sum(((1 - F.grouping(names[k]).cast("int")) * (1 << j) for j, k in enumerate(some)), F.lit(0))
        whole = reduce(lambda a, b: a & b, ((F.grouping(names[k]) == 1) | F.col(names[k]).isNotNull() for k in some))
        groups = rows.groupingSets([[F.col(names[some[j]]) for j in bits(x)] for x in batch], *[F.col(names[k]) for k in some])
        for x, pairs in _agreeing(groups.agg(mark.alias("m"), whole.alias("whole"), F.sum("n").alias("n")).where("whole")).items():
            exactly[x] = pairs
    for j in range(len(some)):
        for x in range(len(exactly)):
            if not x >> j & 1:
                exactly[x] -= exactly[x | 1 << j]
    found = [always | sum(1 << some[j] for j in bits(x)) for x, pairs in enumerate(exactly) if pairs]
    return codes.sparkSession.createDataFrame([(_words(m, n),) for m in found], "mask array<bigint>")  # sets of columns


def _agreeing(groups: DataFrame) -> dict[int, int]:
    """Of groups of sizes `n`, for each `m`: how many pairs of rows share a group."""
    size = F.col("n").cast("decimal(19,0)")
    pairs = groups.where("n > 1").groupBy("m").agg(F.sum(size * (size - 1)).alias("pairs"))
    return {r["m"]: int(r["pairs"]) // 2 for r in pairs.collect()}  # a row for each column set


def _words(mask: int, n: int) -> list[int]:
    return [mask >> at & (1 << WORD) - 1 for at in range(0, n, WORD)]


def _joined(codes: DataFrame, n: int, some: Sequence[int], always: int, total: int) -> DataFrame:
    """Agree sets by equi-joins: pairs that agree in some of these columns meet in the join on the first one where they do;
    all others agree in the columns of `always` only, and are there if those pairs are fewer than the total."""
    rows = codes if "id" in codes.columns else numbered(codes)
    left, right = _sides(rows, n)
    found = []
    for at, k in enumerate(some):
        earlier = reduce(lambda a, b: a & b, (~F.coalesce(F.col(f"lc{j}") == F.col(f"rc{j}"), F.lit(False)) for j in some[:at]), F.lit(True))
        found.append(left.join(right, (F.col(f"lc{k}") == F.col(f"rc{k}")) & (F.col("lid") < F.col("rid")) & earlier).select(agree_mask("l", "r", n).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n")))
    counted = reduce(DataFrame.union, found)
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    others = sums.where(F.col("n") < total).select(F.array(*[F.lit(w).cast("long") for w in _words(always, n)]).alias("mask"))
    return counted.select("mask").distinct().union(others)


def _order(n: int, k: Column, falling: bool = True) -> list[Column]:
    """Within a column's clusters: by the column before it, then by the one after it, both falling (cyclic); or the reverse."""
    pick = lambda shift: F.get(F.col("codes"), F.pmod(k + shift, F.lit(n)))
    return [pick(-1).desc(), pick(1).desc()] if falling else [pick(-1).asc(), pick(1).asc()]


def unpivoted(codes: DataFrame, n: int) -> DataFrame:
    """A row for each row and column: `k`, `code`, all `codes`; rows with a null code there are in no cluster."""
    everything = F.array(*[F.col(f"c{k}") for k in range(n)])
    extra = [c for c in codes.columns if c == "id"]
    return codes.select(everything.alias("codes"), *extra, F.posexplode(everything).alias("k", "code")).where("code is not null")


def _mask_of_codes(left: Column, right: Column, n: int) -> Column:
    words = []
    for at in range(0, max(n, 1), 62):
        same = [F.when(F.get(left, F.lit(k)) == F.get(right, F.lit(k)), F.lit(1 << (k - at)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(at, min(n, at + 62))]
        words.append(reduce(lambda a, b: a + b, same))
    return F.array(*words)


def cluster_windows(codes: DataFrame, distances: Sequence[int] = (1, 2), columns: Sequence[int] | None = None) -> DataFrame:
    """`mask`, `k`, `distance` of pairs so far apart in a column's clusters, sorted by their neighbour columns.

    Clusters of more than CLUSTER_ROWS rows are divided into ranges of their order; pairs across the bounds meet by
    their places in the whole cluster. So the pairs are the same whatever a cluster's size.
    """
    n = width(codes)
    long = unpivoted(codes, n)
    if columns is not None:
        long = long.where(F.col("k").isin(list(columns)))
    return _neighbours(long, n, distances)


def _neighbours(long: DataFrame, n: int, distances: Sequence[int], most_rows: int | None = None) -> DataFrame:
    """Pairs of neighbours; `most_rows`, if known, is no less than the rows of any cluster."""
    order = [*_order(n, F.col("k")), F.col("id") if "id" in long.columns else F.xxhash64("codes")]
    w = Window.partitionBy("k", "code").orderBy(*order)
    if most_rows is not None and most_rows <= CLUSTER_ROWS:
        return _pairs(long, w, n, distances)
    sizes = long.groupBy("k", "code").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    hot = sizes.where(F.col("size") > CLUSTER_ROWS)
    hot_rows = hot.agg(F.sum("size")).first()[0]
    some = sizes.where(F.col("size") <= CLUSTER_ROWS).select("k", "code")
    out = _pairs(long.join(some, ["k", "code"]), w, n, distances)
    if hot_rows is None:
        return out
    ranges = long.join(hot.select("k", "code"), ["k", "code"]).repartitionByRange(-(-hot_rows // CLUSTER_ROWS), "k", "code", *order)
    parted = materialize(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    out = out.union(_pairs(parted, Window.partitionBy("k", "code", "part").orderBy(*order), n, distances))
    counts = parted.groupBy("k", "code", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "code").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    placed = parted.withColumn("i", F.row_number().over(Window.partitionBy("k", "code", "part").orderBy(*order))).join(counts.withColumn("before", before), ["k", "code", "part"])
    most = max(distances, default=0)
    ends = placed.where((F.col("i") <= most) | (F.col("i") > F.col("n") - most)).select("k", "code", "codes", "part", (F.col("before") + F.col("i")).alias("at"))
    ends = materialize(ends, "ends")
    ahead = ends.select("k", "code", "codes", "part", F.explode(F.array(*map(F.lit, distances))).alias("distance"), "at").withColumn("at", F.col("at") + F.col("distance"))
    across = ahead.join(ends.select("k", "code", "at", F.col("codes").alias("other"), F.col("part").alias("beyond")), ["k", "code", "at"]).where("part <> beyond")
    return out.union(across.select(_mask_of_codes(F.col("codes"), F.col("other"), n).alias("mask"), "k", "distance"))


def _pairs(long: DataFrame, w: WindowSpec, n: int, distances: Sequence[int]) -> DataFrame:
    ahead = long.select("k", "codes", *[F.lead("codes", d).over(w).alias(f"o{d}") for d in distances])
    pairs = ahead.select("k", "codes", F.explode(F.array(*[F.struct(F.lit(d).alias("distance"), F.col(f"o{d}").alias("other")) for d in distances])).alias("p"))
    return pairs.where("p.other is not null").select(_mask_of_codes(F.col("codes"), F.col("p.other"), n).alias("mask"), "k", "p.distance")


class Sampler:
    """Agree sets of neighbours in clusters, at growing distances, from the columns that yield most.

    A column goes on while new masks per comparison stay over the threshold, which is halved whenever the sampler is
    resumed. Of large tables it looks at whole clusters, about SAMPLE_ROWS rows for each column: those of values with a
    certain hash, or, where a column has few values, of values together with those of its neighbour columns, by which
    clusters are sorted. So rows that would be neighbours stay neighbours, however large the table is.
    """

    def __init__(self, codes: DataFrame, rows: int, threshold: float = 0.01):
        self.n, self.threshold = width(codes), threshold
        self.seen: set[int] = set()
        self.yields, self.round = dict.fromkeys(range(self.n), 1.0), dict.fromkeys(range(self.n), 0)
        self.runs = 0
        self.long = self._sampled(codes, -(-rows // SAMPLE_ROWS))
        self.rows = rows if rows <= CLUSTER_ROWS else max((r["count"] for r in self.long.groupBy("k").count().collect()), default=0)

    def _sampled(self, codes: DataFrame, share: int) -> DataFrame:
        if not self.n:
            return unpivoted(codes, self.n)
        if share <= 1:
            return materialize(unpivoted(codes.distinct(), self.n), "sample")
        counts = codes.agg(*[F.approx_count_distinct(f"c{k}", 0.1) for k in range(self.n)]).first()
        everything, sides = F.array(*[F.col(f"c{k}") for k in range(self.n)]), []
        for k in range(self.n):
            by = [f"c{(k + j) % self.n}" for j in ((0,) if counts[k] >= share * SAMPLE_CLUSTERS else (-1, 0, 1))]
            taken = codes.where((F.pmod(F.xxhash64(F.lit(k), *by), F.lit(share)) == 0) & F.col(f"c{k}").isNotNull())
            sides.append(taken.select(everything.alias("codes"), F.lit(k).alias("k"), F.col(f"c{k}").alias("code")))
        return materialize(reduce(DataFrame.unionAll, sides).distinct(), "sample")

    def run(self) -> set[int]:
        """Rounds until no column reaches the threshold; all masks so far. Another call resumes with half of it."""
        self.threshold /= 2 if self.runs else 1
        self.runs += 1
        while active := [k for k in range(self.n) if self.yields[k] > self.threshold and self.round[k] < len(ROUNDS)]:
            least = min(self.round[k] for k in active)
            active = [k for k in active if self.round[k] == least]
            found = _neighbours(self.long.where(F.col("k").isin(active)), self.n, ROUNDS[least], self.rows).groupBy("k", "mask").agg(F.count(F.lit(1)).alias("n")).collect()  # sets of columns
            for k in active:
                mine = [(mask_of(r["mask"]), r["n"]) for r in found if r["k"] == k]
                self.yields[k] = sum(m not in self.seen for m, _ in mine) / max(1, sum(c for _, c in mine))
                self.round[k] += 1
            self.seen |= {mask_of(r["mask"]) for r in found}
        return self.seen


def progressive_windows(codes: DataFrame, threshold: float = 0.01) -> set[int]:
    """Masks from clusters at growing distances, of the columns whose yield stays over the threshold."""
    return Sampler(codes, codes.count(), threshold).run()


def record_windows(codes: DataFrame, distance: int = 100) -> DataFrame:
    """`mask` of rows whose ids (gapless, in record order) differ by less than `distance`: a band join in blocks of ids."""
    n = width(codes)
    left, right = _sides(codes, n)
    block = lambda c: F.floor(F.col(c) / distance)
    left = left.withColumn("b", block("lid"))
    right = right.select("*", F.explode(F.array(block("rid"), block("rid") - 1)).alias("b"))
    near = (F.col("rid") > F.col("lid")) & (F.col("rid") < F.col("lid") + distance)
    return left.join(right, "b").where(near).select(agree_mask("l", "r", n).alias("mask")).distinct()


def small_clusters(codes: DataFrame, max_size: int = 16) -> DataFrame:
    """`mask` of all pairs within clusters of at most `max_size` rows; larger ones are for `cluster_windows`."""
    n = width(codes)
    long = unpivoted(codes, n)
    small = long.groupBy("k", "code").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, max_size))
    rows = long.join(small, ["k", "code"]).select("k", "code", "id", "codes")
    other = rows.select("k", "code", F.col("id").alias("oid"), F.col("codes").alias("other"))
    return rows.join(other, ["k", "code"]).where("id < oid").select(_mask_of_codes(F.col("codes"), F.col("other"), n).alias("mask")).distinct()


def tops_and_bottoms(codes: DataFrame, depth: int = 3) -> DataFrame:
    """`mask` of the first and the last `depth` rows of each cluster, each with each.

    The ends of END_PARTS parts of a cluster are found first, and of these the cluster's, so that no task holds a
    large cluster.
    """
    n = width(codes)
    order = [*_order(n, F.col("k")), F.col("id")]
    falling = [*_order(n, F.col("k"), falling=False), F.col("id").desc()]

    def ends(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("k", "code", *by)
        ranked = rows.withColumn("top", F.row_number().over(w.orderBy(*order))).withColumn("bottom", F.row_number().over(w.orderBy(*falling)))
        return ranked.where((F.col("top") <= depth) | (F.col("bottom") <= depth))

    parts = ends(unpivoted(codes, n).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(END_PARTS))), "part")
    both = ends(parts)
    first = both.where(F.col("top") <= depth).select("k", "code", "id", "codes")
    last = both.where(F.col("bottom") <= depth).select("k", "code", F.col("id").alias("oid"), F.col("codes").alias("other"))
    return first.join(last, ["k", "code"]).where("id <> oid").select(_mask_of_codes(F.col("codes"), F.col("other"), n).alias("mask")).distinct()


def pivot_masks(codes: DataFrame, pivot: int) -> DataFrame:
    """`mask` of one row (by id) with every row that agrees with it somewhere: its clusters merged by row."""
    n = width(codes)
    one = F.broadcast(codes.where(F.col("id") == pivot).select(*[F.col(f"c{k}").alias(f"rc{k}") for k in range(n)]))  # one row
    some = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"c{k}") == F.col(f"rc{k}"), F.lit(False)) for k in range(n)))
    both = codes.where(F.col("id") != pivot).join(one, some)
    return both.select(*[F.col(f"c{k}").alias(f"lc{k}") for k in range(n)], *[f"rc{k}" for k in range(n)]).select(agree_mask("l", "r", n).alias("mask")).distinct()


def new_masks(found: DataFrame, known: Iterable[int], spark) -> DataFrame:
    """Masks that aren't among the known ones."""
    words = [([m >> 62 * k & (1 << 62) - 1 for k in range(max(1, -(-m.bit_length() // 62)))],) for m in known]
    return found.select("mask").distinct().join(spark.createDataFrame(words, "mask array<bigint>"), "mask", "left_anti")
