"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Samples go into overlapping frames, a frame's spectrum into the twelve pitch classes. Sixteen filters compare areas of
that image, found from its integral image; each value is quantized to two bits of a Gray code, so that a step of time
gives one packed integer of 32 bits. Images are kept in whole numbers, so a recording has the same integers whatever
is computed beside it.

Recordings with the same integers are one class. Every place of an integer votes for every place of it in a class of a
smaller id and the offset between them; of the offsets whose bit errors over the overlap confirm them, the one with the
most votes is the alignment. Classes are divided by their ids' order into blocks. A task holds the integers of one block,
sorted, and reads those of all classes up to its own, so votes of two recordings are counted where they are cast and are
neither written nor shuffled, though they grow with the square of how often an integer comes. What is shuffled is a
class's integers, once for each block from its own on.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize

RATE, FRAME, HOP = 11025, 512, 64
LOWEST, HIGHEST = 65.0, 3520.0
SCALE = 10_000
#: Frames whose spectra are taken at once, and bytes of recordings.
BLOCK, CHUNK = 2048, 1 << 18
#: Kind, first pitch class, classes, frames of each filter.
FILTERS = [(0, 0, 6, 8), (0, 6, 6, 8), (1, 0, 12, 8), (1, 2, 8, 4), (1, 4, 6, 8), (2, 0, 12, 8), (2, 0, 6, 4), (2, 6, 6, 6), (3, 0, 12, 8), (3, 2, 6, 6), (3, 6, 6, 4), (4, 0, 9, 8), (4, 3, 9, 4), (4, 0, 12, 6), (5, 0, 12, 6), (5, 2, 8, 3)]
#: Where each filter's values divide into four about equal parts.
QUARTILES = np.array([[-0.42, -0.29, -0.14], [0.14, 0.29, 0.42], [0.14, 0.29, 0.42], [0.06, 0.27, 0.46], [0.15, 0.31, 0.47], [-0.02, 0.0, 0.02], [-0.09, 0.0, 0.09], [-0.06, 0.0, 0.06], [-0.07, 0.0, 0.07], [-0.11, 0.0, 0.11], [-0.09, 0.0, 0.09], [-0.89, -0.76, -0.62], [-0.87, -0.71, -0.55], [-0.92, -0.78, -0.65], [-0.71, -0.69, -0.68], [-0.71, -0.69, -0.68]])
WIDTH = max(f[3] for f in FILTERS)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: An alignment has so many votes, and at most so many wrong bits of 100.
MIN_VOTES, MAX_ERRORS = 2, 35
#: Integers of a block's recordings, the least number of blocks that a larger table has, and integers for each of these.
BLOCK_CODES, BLOCKS, FEW_CODES = 16_000_000, 12, 100_000
#: Ranges of ids for each block, votes that are counted at once, and integers that are compared at once.
RANGES, PAIRS = 4, 1 << 21

_HZ = np.arange(FRAME // 2 + 1) * RATE / FRAME
_BINS = np.flatnonzero((_HZ >= LOWEST) & (_HZ <= HIGHEST))
_CLASS = np.round(12 * np.log2(_HZ[_BINS] / 440)).astype(int) % 12
_ORDER = _BINS[np.argsort(_CLASS, kind="stable")]
_STARTS = np.searchsorted(np.sort(_CLASS), np.arange(12))
_HANN = np.hanning(FRAME).astype(np.float32)


def samples(media: bytes) -> np.ndarray:
    """Samples of a WAV file, channels averaged; other bytes are unsigned 8-bit samples of one channel."""
    if media[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(media)) as w:
                raw, channels, width = w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth()
            if width in (1, 2):
                x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], "u1" if width == 1 else "<i2").astype(np.float32)
                x = (x - 128) / 128 if width == 1 else x / 32768
                return x.reshape(-1, channels).mean(axis=1, dtype=np.float32)
        except (wave.Error, EOFError):
            pass
    return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128


def image(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of twelve whole numbers for the frames of all parts, and how many frames each has."""
    n = np.array([max(0, (len(p) - FRAME) // HOP + 1) for p in parts])
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    at = np.repeat(begins, n) + HOP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    data, out = np.concatenate(parts) if parts else np.zeros(0, np.float32), np.zeros((len(at), 12), np.int64)
    for k in range(0, len(at), BLOCK):
        frames = data[at[k : k + BLOCK, None] + np.arange(FRAME)] * _HANN
        spectrum = np.fft.rfft(frames, axis=1)[:, _ORDER]
        energy = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, _STARTS, axis=1)
        norm = np.sqrt((energy.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        out[k : k + BLOCK] = np.where(norm > 1e-6, np.rint(SCALE * energy / np.maximum(norm, 1e-6)), 0)
    return out, n


def _area(total: np.ndarray, n: int, t: int, y: int, w: int, h: int) -> np.ndarray:
    """Sums over `w` frames from t on and `h` classes from y on, for each of n steps."""
    return total[t + w : t + w + n, y + h] - total[t : t + n, y + h] - total[t + w : t + w + n, y] + total[t : t + n, y]


def responses(chroma: np.ndarray) -> np.ndarray:
    """The sixteen filters' values at each step: log ratios of the two areas that a filter compares."""
    n = len(chroma) - WIDTH + 1
    total = np.zeros((len(chroma) + 1, 13), np.int64)
    total[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    out = np.empty((n, len(FILTERS)))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        area = lambda t, dy, ww, hh, y=y: _area(total, n, t, y + dy, ww, hh)
        whole = area(0, 0, w, h)
        if kind == 0:
            one, two = whole, _area(total, n, 0, 0, w, 12) - whole
        elif kind == 1:
            one, two = area(0, h // 2, w, h - h // 2), area(0, 0, w, h // 2)
        elif kind == 2:
            one, two = area(w // 2, 0, w - w // 2, h), area(0, 0, w // 2, h)
        elif kind == 3:
            one = area(0, h // 2, w // 2, h - h // 2) + area(w // 2, 0, w - w // 2, h // 2)
            two = whole - one
        elif kind == 4:
            one = area(0, h // 3, w, h // 3)
            two = whole - one
        else:
            one = area(w // 3, 0, w // 3, h)
            two = whole - one
        out[:, k] = np.log((1.0 + one) / (1.0 + two))
    return out


def codes(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed integers of all parts, how many each has, and how many frames."""
    chroma, frames = image(parts)
    n = np.maximum(0, frames - WIDTH + 1)
    if not n.any():
        return np.zeros(0, np.uint32), n, frames
    values = responses(chroma)
    packed = np.zeros(len(values), np.uint32)
    for k in range(len(FILTERS)):
        packed |= GRAY[np.searchsorted(QUARTILES[k], values[:, k], side="right")] << np.uint32(2 * k)
    begins = np.cumsum(frames) - frames
    pick = np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return packed[pick], n, frames


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(keys: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
        packed, n, frames = codes(parts)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([keys, pa.array(frames.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(packed.view(np.int32)))], names=["id", "frames", "codes"])

    for batch in batches:
        parts, size, at = [], 0, 0
        for i, m in enumerate(batch.column(1)):
            parts.append(samples(m.as_py() or b""))
            size += len(parts[-1])
            if size >= CHUNK:
                yield done(batch.column(0).slice(at, len(parts)), parts)
                parts, size, at = [], 0, i + 1
        if parts:
            yield done(batch.column(0).slice(at, len(parts)), parts)


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row: `id`, `frames`, `codes` (packed integers); none for a null, empty or short recording."""
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").cast("binary").alias("m"))
    return rows.mapInArrow(_fingerprinted, f"id {kind}, frames long, codes array<int>")


def _errors(x: np.ndarray, y: np.ndarray, x_from: np.ndarray, y_from: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Bits in which stretches of x and y differ."""
    out, ends, a = np.empty(len(steps), np.int64), np.cumsum(steps), 0
    while a < len(steps):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - steps[a] + PAIRS, "right")))
        n = steps[a:b]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(starts, n)
        wrong = np.bitwise_count((x[np.repeat(x_from[a:b], n) + at] ^ y[np.repeat(y_from[a:b], n) + at]).view(np.uint32))
        out[a:b], a = np.add.reduceat(wrong, starts, dtype=np.int64), b
    return out


class _Recordings:
    """Some classes: their numbers, integers, and places of these that are the first in a run of equal ones."""

    def __init__(self, c: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
        self.c, self.sizes, self.codes, self.begins = c, sizes, codes, np.cumsum(sizes) - sizes
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        new[self.begins] = True
        places = np.flatnonzero(new)
        self.v = codes[places]
        self.doc = np.repeat(np.arange(len(c), dtype=np.int32), sizes)[places]
        self.at = (places - self.begins[self.doc]).astype(np.int32)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Recordings:
        sizes = batch.column(3).value_lengths().to_numpy().astype(np.int64)
        return cls(batch.column(1).to_numpy(), sizes, batch.column(3).flatten().to_numpy())


class _Voters:
    """A block's recordings and the best alignment of each so far. `lo` is the least number of a class with the same id."""

    def __init__(self, own: _Recordings, lo: np.ndarray):
        order = np.argsort(own.v, kind="stable")
        self.own, self.lo, self.v, self.doc, self.at = own, lo, own.v[order], own.doc[order], own.at[order]
        #: The reference's number, the offset, votes, overlap and errors.
        self.ref, self.offset, self.n, self.overlap, self.errors = np.zeros((5, len(lo)), np.int64)
        del own.v, own.doc, own.at

    def compare(self, refs: _Recordings) -> None:
        """Let all places vote for the places of some other recordings with smaller ids."""
        first = np.searchsorted(self.v, refs.v, "left")
        count = np.searchsorted(self.v, refs.v, "right") - first
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[np.searchsorted(refs.doc, np.arange(len(refs.c) + 1))]
        a = 0
        while a < len(refs.c):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PAIRS, "right")) - 1)
            parts = [self._votes(refs, first, ends, p, min(int(bounds[b]), p + PAIRS), a, b - a) for p in range(int(bounds[a]), int(bounds[b]), PAIRS)]
            if parts:
                self._judge(refs, a, b - a, *(parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))))
            a = b

    def _span(self, refs: _Recordings) -> tuple[int, int]:
        longest = int(refs.sizes.max())
        return longest, longest + int(self.own.sizes.max())

    def _votes(self, refs: _Recordings, first: np.ndarray, ends: np.ndarray, p: int, q: int, a: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The votes from p to q: recording, reference and offset as one number, and how many there are."""
        i, j = int(np.searchsorted(ends, p, "right")) - 1, int(np.searchsorted(ends, q, "left"))
        there = np.repeat(np.arange(i, j), np.minimum(ends[i + 1 : j + 1], q) - np.maximum(ends[i:j], p))
        here = first[there] + np.arange(p, q) - ends[there]
        ok = refs.c[refs.doc[there]] < self.lo[self.doc[here]]
        here, there = here[ok], there[ok]
        longest, span = self._span(refs)
        keys = (self.doc[here].astype(np.int64) * docs + refs.doc[there] - a) * span + self.at[here] - refs.at[there] + longest
        return np.unique(keys, return_counts=True)

    def _judge(self, refs: _Recordings, a: int, docs: int, keys: np.ndarray, n: np.ndarray) -> None:
        """Take the offsets with enough votes, in the order of their rank, and keep the first that the bit errors confirm."""
        keys, n = keys[n >= MIN_VOTES], n[n >= MIN_VOTES]
        longest, span = self._span(refs)
        offset, doc = keys % span - longest, keys // span
        voter, doc = doc // docs, doc % docs + a
        ref, old = refs.c[doc], (self.n[voter], self.ref[voter], self.offset[voter])
        better = (n > old[0]) | ((n == old[0]) & ((ref < old[1]) | ((ref == old[1]) & (offset < old[2]))))
        order = np.flatnonzero(better)
        order = order[np.lexsort((offset[order], ref[order], -n[order], voter[order]))]
        offset, doc, voter, ref, n = (x[order] for x in (offset, doc, voter, ref, n))
        most = 1
        while len(n):
            starts = np.flatnonzero(np.concatenate([[True], voter[1:] != voter[:-1]]))
            now = np.arange(len(n)) - np.repeat(starts, np.diff(np.append(starts, len(n)))) < most
            k = np.flatnonzero(now)
            begin = np.maximum(0, offset[k])
            steps = np.minimum(self.own.sizes[voter[k]], refs.sizes[doc[k]] + offset[k]) - begin
            wrong = _errors(self.own.codes, refs.codes, self.own.begins[voter[k]] + begin, refs.begins[doc[k]] + begin - offset[k], steps)
            stands = np.flatnonzero(100 * wrong <= MAX_ERRORS * 32 * steps)
            who, at = np.unique(voter[k[stands]], return_index=True)
            at = stands[at]
            for column, x in zip((self.ref, self.offset, self.n, self.overlap, self.errors), (ref[k], offset[k], n[k], steps, wrong), strict=True):
                column[who] = x[at]
            rest = ~now & ~np.isin(voter, who)
            offset, doc, voter, ref, n = (x[rest] for x in (offset, doc, voter, ref, n))
            most *= 2


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return (keys[starts], np.add.reduceat(n[order], starts)) if len(keys) else (keys, n)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (other, number, lo, codes), the own ones of a block first: the best alignment of each of these."""
    own: list[pa.RecordBatch] = []
    voters = None

    def held() -> _Voters:
        parts = [_Recordings.of(b) for b in own]
        join = lambda f: np.concatenate([f(x) for x in parts])
        whole = _Recordings(join(lambda x: x.c), join(lambda x: x.sizes), join(lambda x: x.codes))
        voters = _Voters(whole, np.concatenate([b.column(2).to_numpy() for b in own]))
        for x in parts:
            voters.compare(x)
        return voters

    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            others = part.column(0).to_numpy(zero_copy_only=False)
            mine = int(np.searchsorted(others, True))
            if mine:
                own.append(part.slice(0, mine))
            if own and mine < len(others):  # a block may be empty
                voters = voters or held()
                voters.compare(_Recordings.of(part.slice(mine)))
    if own:
        voters = voters or held()
        k = np.flatnonzero(voters.n)
        for at in range(0, len(k), 10_000):
            some = k[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (voters.own.c, voters.ref, voters.offset, voters.overlap, voters.errors)], names=["c", "ref", "offset", "overlap", "errors"])


def align(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row: the id, `n_frames`, `n_codes`, `codes_sha256`, `class_id`, and `aligned_to`, `offset`, `votes`, `overlap`, `bit_errors`.

    `class_id` is the smallest id with the same integers, null if there are none or the row has no id. Of a class, each
    integer's first place in a run of equal ones votes for each such place in the classes of smaller ids. An offset
    stands if it has MIN_VOTES and at most MAX_ERRORS of 100 bits differ over the overlap; the alignment is the one with
    the most votes, then the smallest id and offset, and null if none stands. `votes` counts those of its votes that are
    for the first place of their integer in the table, so it may be 0. Rows that repeat an id share their class's
    alignment if they hold the same integers, and align each by itself if not, but never with each other. Of recordings of
    one id that tie, the one with the smaller hash of its integers counts. An empty table gives no rows; recordings may be
    as long as a row can be, and other columns are left out, so that no name clashes.
    """
    found = materialize(fingerprints(media, id_col, media_col), "codes")
    found = found.select("*", F.xxhash64("codes").alias("f1"), F.xxhash64(F.lit(1), "codes").alias("f2"))
    named = found.where(F.col("id").isNotNull() & (F.size("codes") > 0))
    classes = materialize(named.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.withColumnRenamed("rep", "id"), ["f1", "f2", "id"]).dropDuplicates(["id", "f1", "f2"])  # rows of one class have equal codes
    total = named.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CODES), min(BLOCKS, -(-total // FEW_CODES)))
    by = Window.partitionBy("id").orderBy("f1", "f2")
    ranged = reps.repartitionByRange(RANGES * blocks, "id").withColumn("j", F.row_number().over(by)).sortWithinPartitions("id", "f1", "f2")
    # numbers rise with the id, then f1 and f2; `range` is that of the id
    ranged = ranged.select("id", "f1", "f2", "codes", "j", F.monotonically_increasing_id().alias("c"), F.spark_partition_id().alias("range"))
    ranged = materialize(ranged.select("id", "f1", "f2", "codes", "c", (F.col("c") - F.col("j") + 1).alias("lo"), "range"), "classes")
    sizes = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum(F.size("codes")).alias("n")).collect())  # a row for each range
    block, done, every = {}, 0, sum(n for _, n in sizes)
    for number, n in sizes:
        block[number], done = min(blocks - 1, done * blocks // max(every, 1)), done + n
    steps = F.transform("codes", lambda v, i: F.struct(v.alias("v"), i.alias("at"), F.get("codes", i - 1).alias("last")))
    places = ranged.select("c", F.explode(steps).alias("s")).where("s.last is null or s.last <> s.v").select("s.v", F.struct("c", F.col("s.at").alias("at")).alias("p"))
    leads = places.groupBy("v").agg(F.min("p").alias("p")).groupBy("p.c").agg(F.collect_list("p.at").alias("lead"))  # of each integer, the first place
    in_block = F.get(F.array(*[F.lit(block.get(k, 0)) for k in range(RANGES * blocks)]), F.col("range"))
    rows = ranged.select("c", "lo", "codes", in_block.alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("task")).select("task", (F.col("task") != F.col("block")).alias("other"), "c", "lo", "codes")
    rows = rows.repartitionById(blocks, F.col("task").cast("int")).sortWithinPartitions("other").select("other", "c", "lo", "codes")
    peaks = materialize(rows.mapInArrow(_aligned, "c long, ref long, offset long, overlap long, errors long"), "peaks")
    leads = leads.select(F.col("c").alias("ref"), "lead")
    peaks = peaks.join(ranged.select("c", "f1", "f2", "codes"), "c").join(ranged.select(F.col("c").alias("ref"), F.col("id").alias("smaller"), F.col("codes").alias("other")), "ref").join(leads, "ref", "left")
    at = lambda s: (s + F.col("offset")).cast("int")
    cast = F.filter("lead", lambda s: (F.get("codes", at(s)) == F.get("other", s)) & ((at(s) == 0) | (F.get("codes", at(s) - 1) != F.get("other", s))))
    peaks = peaks.select("f1", "f2", F.col("smaller").alias("ref"), "offset", F.coalesce(F.size(cast), F.lit(0)).cast("long").alias("votes"), "overlap", "errors")
    out = found.select("id", "frames", F.size("codes").cast("long").alias("n"), F.sha2(F.array_join("codes", " "), 256).alias("sha"), "f1", "f2").join(classes, ["f1", "f2"], "left").join(peaks, ["f1", "f2"], "left")
    own = lambda c: F.when(F.col("id").isNotNull(), F.col(c))
    return out.select(F.col("id").alias(id_col), F.col("frames").alias("n_frames"), F.col("n").alias("n_codes"), F.col("sha").alias("codes_sha256"), own("rep").alias("class_id"), own("ref").alias("aligned_to"), own("offset").alias("offset"), own("votes").alias("votes"), own("overlap").alias("overlap"), own("errors").alias("bit_errors"))
