"""Near-duplicates by min-max hashing of word shingles, with exact confirmation.

Under each permutation both the smallest and the largest value of a set are kept, so 100 permutations give 200 values
and half the hash evaluations; the two are unbiased and nearly independent, and no noisier than two minima. Bands are
of five values: a pair of similarity 0.8 misses all 40 with a chance of 1.2e-7. Texts with the same set are one class.
Links are then found in three steps, so that a large group of copies isn't expanded into pairs:

1. each class of a bucket is compared with the bucket's smallest, its centre, on full sets, unless a sketch of one bit
   a value shows that they are far apart (4 standard deviations below 0.6);
2. of x and y that were compared with one centre, x without a link to it, what differs from the centre tells all: with
   D the difference of a set and the centre's, x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, so a link needs a
   large common part of Dx and Dy, hence a common element among the first of each in one order (prefix filter). Added
   shingles come first; they are rare. A bitmap in which each element of D flips one bit of 512 bounds from below in
   how much x and y differ. Only pairs of two components that meet and pass the bound become rows; this step is exact;
3. classes far from a bucket's centre have no link to those near it (Jaccard distance is a metric), and are compared
   with the bucket's others that have no link to the centre: by sketches (5.5 standard deviations), then on full sets.

What is counted for each bucket or centre is written before it is joined back, so that both sides of such a join are
plain shuffles and Spark divides a hot bucket or centre at run time (its skew join can't divide an aggregate).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BATCH_ROWS, renamed
from lodestar.llm.components import components
from lodestar.llm.shingles import mix, numbers, shingle_sets
from lodestar.plans.scratch import materialize

PERMUTATIONS, BAND = 100, 5
BANDS = 2 * PERMUTATIONS // BAND
PERCENT = 80
#: Members that are compared with their centre in one task's run of rows; beyond, the centre is repeated.
MEMBERS = 256
#: Bytes of text that are hashed at once, so that the arrays stay in the cache.
CHUNK = 1 << 19

_FACTOR = (numbers(PERMUTATIONS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (numbers(PERMUTATIONS, 13) >> np.uint64(32)).astype(np.uint32)
_BAND_SEED = numbers(BANDS, 17)
_M = np.uint64(0x9E3779B97F4A7C15)


def least_agreement(percent: int, deviations: float) -> int:
    """Bits of 200 that the sketches of a pair of this similarity share, less some standard deviations."""
    p = (1 + percent / 100) / 2
    n = 2 * PERMUTATIONS
    return int(n * p - deviations * (n * p * (1 - p)) ** 0.5)


def min_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 200 values for each set: minima, then maxima. No set may be empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * PERMUTATIONS, len(starts)), np.uint32)
    for p in range(PERMUTATIONS):
        y = x * _FACTOR[p] + _SHIFT[p]
        y ^= y >> np.uint32(15)
        out[p] = np.minimum.reduceat(y, starts)
        out[PERMUTATIONS + p] = np.maximum.reduceat(y, starts)
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes, with the place of the first."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(column):
        b = t.as_py() or b""
        texts.append(b)
        size += len(b)
        if size >= CHUNK:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def _signatures(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _chunks(batch.column(1)):
            values, bounds = shingle_sets(texts, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            bands = np.zeros((len(texts), BANDS), np.int64)
            s1, s2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            sketch = np.zeros((len(texts), 4), np.int64)
            if len(full):
                starts = bounds[:-1][full]
                sig = min_max(values, starts)
                for b in range(BANDS):
                    key = np.full(len(full), _BAND_SEED[b])
                    for row in sig[b * BAND : (b + 1) * BAND]:
                        key = mix(key * _M + row)
                    bands[full, b] = key.view(np.int64)
                bits = np.zeros((len(full), 256), np.uint8)
                bits[:, : len(sig)] = ((sig * np.uint32(2654435769)) >> np.uint32(31)).T
                sketch[full] = np.packbits(bits, axis=1).view(np.int64)
                s1[full] = np.add.reduceat(mix(values), starts)
                s2[full] = np.add.reduceat(mix(values + _M), starts)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[n > 0].ravel())), *(pa.array(sketch[:, j]) for j in range(4))],
                names=["id", "n", "s1", "s2", "bands", "k1", "k2", "k3", "k4"],
            )


def _prefix(centre: np.ndarray, mine: np.ndarray, percent: int) -> tuple[bool, np.ndarray, int]:
    """Whether they are linked, what is in one of them only (first what the centre lacks), and how much of it to look up.

    Sets x and y are linked if they differ in at most q (|x| + |y|) elements. The bounds are the least common part of
    Dx and Dy in a link of x, which has none to the centre, with any y; and of y, which has one, with any such x.
    """
    both = np.concatenate([centre, mine])
    side = np.zeros(len(both), bool)
    side[len(centre) :] = True
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    twin = both[1:] == both[:-1]
    single = ~(np.concatenate([twin, [False]]) | np.concatenate([[False], twin]))
    shared = int(np.count_nonzero(twin))
    linked = shared > 0 and 100 * shared >= percent * (len(both) - shared)
    apart = np.concatenate([both[single & side], both[single & ~side]])
    q = (100 - percent) / (100 + percent)
    common = (len(apart) + q * (len(centre) - len(mine))) / 2 if linked else len(apart) - q * len(mine) * (1 + 100 / percent)
    return linked, apart, len(apart) - max(1, int(np.ceil(common - 1e-9))) + 1


def _compared(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group, the centre's first: each member and how it differs from the centre."""
    group, centres = None, []
    for batch in batches:
        kept: list[tuple] = []
        for at, texts in _chunks(batch.column(3)):
            values, bounds = shingle_sets(texts, size)
            groups = list(zip(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist(), strict=True))
            ids = batch.column(2).slice(at, len(texts)).to_pylist()
            for k, g in enumerate(groups):
                mine = values[bounds[k] : bounds[k + 1]]
                if g != group:
                    group, centres = g, []
                if ids[k] == g[0]:
                    centres.append(mine.copy())
                    continue
                for c in centres:
                    linked, apart, first = _prefix(c, mine, percent)
                    flips = np.packbits((np.bincount(apart & np.uint64(511), minlength=512) & 1).astype(np.uint8)).view(np.int64)
                    kept.append((g[0], ids[k], len(mine), linked, apart.view(np.int64), first, flips))
        types = [batch.column(2).type, batch.column(2).type, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in kept], t) for j, t in enumerate(types)], names=["a", "b", "m", "linked", "apart", "first", "flips"])


def compare(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The distinct pairs of a centre `a` and a member `b`, compared on the full sets of their texts (`id`, `t`).

    `m` is the member's size, `linked` whether they are similar enough, `apart` how the sets differ, `first` how many
    elements of that to look up, and `flips` a bitmap of it. A centre with many members is repeated for each MEMBERS of them, so that no task holds more than a run of rows; a
    text is sent once for each pair of which it is the member, and once for each run of which it is the centre.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    n = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")), "parts")
    runs = pairs.join(n, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    rows = runs.union(runs.select("a", "part", F.col("a").alias("id")).distinct())
    full = rows.join(texts, "id").select("a", "part", "id", "t")
    ready = full.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
    return ready.mapInArrow(lambda batches: _compared(size, percent, batches), f"a {kind}, b {kind}, m long, linked boolean, apart array<long>, first int, flips array<long>")


def _alike(x: str, y: str, percent: int, agreement: int) -> Column:
    """Whether sizes allow for the similarity and sketches agree so far."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = sum((F.bit_count(c(x, k).bitwiseXOR(c(y, k))) for k in ("k1", "k2", "k3", "k4")), F.lit(0))
    sizes = 100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))
    return sizes & (2 * PERMUTATIONS - apart >= agreement)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: the id, `n_shingles`, `component_id` (the smallest id reachable over links), `kept` (it is its own).

    Words are lower-cased in A-Z. Null and empty texts have no shingles and no links. Rows without an id are linked
    with nothing: their `component_id` is null and they are kept. Rows that repeat an id are one node. Tables may be
    empty, and texts as long as a row can be; other columns are left out, so that no name clashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    sig = materialize(texts.mapInArrow(lambda batches: _signatures(size, batches), f"id {kind}, n long, s1 long, s2 long, bands array<long>, k1 long, k2 long, k3 long, k4 long"), "signatures", BATCH_ROWS)
    named = sig.where("n > 0 and id is not null")
    classes = materialize(named.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.select("s1", "s2", F.col("rep").alias("id")), ["s1", "s2", "id"])
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last").drop("last")
    least = materialize(least, "centres")
    shared = materialize(buckets.join(least, "bucket"), "buckets")
    sketches = reps.select("id", "n", "k1", "k2", "k3", "k4")

    stars = shared.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id"))
    far = max(0, 100 - 2 * (100 - percent))
    stars = materialize(stars.where(_alike("x", "y", far, least_agreement(far, 4))).select("a", "b"), "stars")
    compared = materialize(compare(stars, texts, size, percent), "compared", BATCH_ROWS)
    links = compared.where("linked").select("a", "b")
    found = components(links)

    placed = compared.join(found.withColumnRenamed("id", "b"), "b", "left").select("a", "b", "m", F.size("apart").alias("d"), "linked", F.coalesce("component", "b").alias("component"), "flips", F.slice("apart", F.lit(1), F.col("first")).alias("prefix"))
    loose = placed.where("not linked")
    unlinked = materialize(compared.where("not linked").select("a").distinct(), "unlinked")
    sides = [t.select("a", *[F.col(c).alias(f"{v}_{c}") for c in ("b", "m", "d", "linked", "component", "flips")], F.posexplode("prefix").alias(f"{v}_at", "e")) for v, t in (("x", loose), ("y", placed.join(unlinked, "a")))]
    most = (F.col("x_m") + F.col("y_m")) * ((100 - percent) / (100 + percent)) + 1e-9
    common = F.greatest(F.lit(1.0), F.ceil((F.col("x_d") + F.col("y_d") - most) / 2))
    flipped = sum((F.bit_count(F.get("x_flips", F.lit(k)).bitwiseXOR(F.get("y_flips", F.lit(k)))) for k in range(8)), F.lit(0))
    early = (F.col("x_at") <= F.col("x_d") - common) & (F.col("y_at") <= F.col("y_d") - common)
    meet = (F.col("x_component") != F.col("y_component")) & (F.col("y_linked") | (F.col("x_b") < F.col("y_b"))) & early & (flipped <= most)
    met = sides[0].alias("x").join(sides[1].alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & meet).select("x.a", "x_b", "y_b").distinct()
    for v in ("x", "y"):
        met = met.join(compared.select("a", F.col("b").alias(f"{v}_b"), F.col("m").alias(f"{v}_m"), F.col("apart").alias(f"{v}_apart")), ["a", f"{v}_b"])
    both = F.col("x_m") + F.col("y_m")
    differ = F.size("x_apart") + F.size("y_apart") - 2 * F.size(F.array_intersect("x_apart", "y_apart"))
    met = met.where(100 * (both - differ) >= percent * (both + differ))
    links = links.union(materialize(met.select(F.col("x_b").alias("a"), F.col("y_b").alias("b")).distinct(), "links"))

    spots = shared.select("bucket", "centre", "id").join(compared.select(F.col("a").alias("centre"), F.col("b").alias("id"), "linked"), ["centre", "id"], "left")
    spots = spots.where("id <> centre and not coalesce(linked, false)").select("bucket", "id", F.col("linked").isNull().alias("far"))
    spots = spots.join(materialize(spots.where("far").select("bucket").distinct(), "far"), "bucket").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = materialize(spots.join(sketches, "id"), "members")
    x, y = members.where("far").alias("x"), members.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.far") | (F.col("x.id") < F.col("y.id")))
    rest = x.join(y, apart & _alike("x", "y", percent, least_agreement(percent, 5.5))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    rest = materialize(rest, "pairs")
    if not rest.isEmpty():
        links = links.union(materialize(compare(rest, texts, size, percent).where("linked").select("a", "b"), "links", BATCH_ROWS))
    found = components(links)

    home = classes.join(found, classes["rep"] == found["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "n", "s1", "s2").join(home, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, and those without an id; all columns, of whatever names."""
    df, names = renamed(docs)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    gone = near_duplicates(df, key, text, size, percent).where("not kept").select(F.col(key).alias("__id")).distinct()
    return df.join(gone, df[key] == gone["__id"], "left_anti").toDF(*docs.columns)
