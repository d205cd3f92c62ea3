"""Suffix-array dedup: removes bytes of strings of 50 that also start in a document with a smaller id.

Sorting every suffix would move some fifty times the text. Here each string of 50 bytes is represented by one suffix
that starts inside it, its anchor: the place of the least hash of 16 bytes. Equal strings have equal anchors at equal
places, so only suffixes at anchors (one in nineteen) take part, and of those only the ones whose 16 leading bytes
occur elsewhere too:

1. texts are written in groups of some megabytes; everything up to a group is summed up before it is shuffled;
2. splitters sampled from the suffixes' leading bytes, in proportion to the buckets, range-partition the groups'
   distinct anchors into buckets, which report the ones found in two documents. Leading bytes so frequent that several
   splitters fall on them are dealt over the buckets between these by the hash of the 16 bytes;
3. of these the groups send the text around the anchor; a bucket sorts its suffixes word by word (multikey quicksort
   on words of eight bytes), takes the common prefixes of neighbours, and so finds for each string of 50 bytes around
   an anchor the smallest id that has it. Suffixes with 16 equal leading bytes are in one bucket, so no string
   crosses a boundary;
4. anchors of very many groups would make one bucket large. Their strings are dealt by hashes (128 bits) of the whole
   50 bytes instead, one row for each group that has the string, whatever the number of documents;
5. the groups compare each string's smallest id with their documents' and cover the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shingles import mix, numbers
from lodestar.plans.scratch import materialize

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM
GROUP_BYTES = 8 << 20
#: Text for which there is one bucket.
BUCKET_BYTES = 24 << 20
#: Groups that share an anchor, from which its strings are dealt one by one.
HOT_GROUPS = 256
#: Groups from which splitters are sampled, at least; buckets for which there is one group; and leading codes from each.
SAMPLE_GROUPS, SAMPLE_BUCKETS, SAMPLE_CODES = 16, 64, 4096
#: Sampled codes that one task ranks.
RANKED = 1 << 20
#: Starts of strings that are handled at once.
SEGMENT = 1 << 18

_BASE = 0xA24BAED4963EE407
_BYTE = numbers(256, 23)
_PLACE = np.uint64((1 << 20) - 1)
#: A code of six bits for each byte, which keeps their order and tells small letters apart.
_CODE = np.searchsorted(np.array([32, 33, 44, 45, 46, 47, 48, 53, 58, 65, 69, 73, 77, 82, 85, 91, *range(97, 124), 128, 160, 164, 168, 170, 172, 176, 180, 184, 188, 194, 195, 196, 200, 224, 240]), np.arange(256), side="right").astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


_SPAN = SEGMENT + LENGTH + 1
_UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        v, k = np.minimum(v[:-k], v[k:]), 2 * k
    rest = width - k
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: anchors' places and hashes, and the first and last start of the strings they stand for."""
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _UP[: len(part)])])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(part) - GRAM + 1])
        place = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), REACH + 1) & _PLACE
        starts = np.arange(at, at + len(place))
        end = ends[np.searchsorted(ends, starts[[0, -1]], side="right")]
        if end[0] == end[1] and starts[-1] + LENGTH <= end[0]:
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.concatenate([first[1:], [len(place)]]) - 1
        else:
            inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= LENGTH
            edge = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
            first = np.flatnonzero(edge)
            last = np.concatenate([first[1:], [len(place)]]) - 1
            first, last = first[inside[first]], last[inside[first]]
        spot = place[first].astype(np.int64)
        parts.append((spot + at, h[spot], first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def leading_codes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first ten bytes of suffixes as numbers of the same order."""
    code = np.zeros(len(places), np.uint64)
    for j in range(10):
        code = code << np.uint64(6) | _CODE[data[places + j]]
    return code


def buckets_of(codes: np.ndarray, hashes: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The bucket of each suffix by its leading code; where splitters equal the code, by its hash one of those they border."""
    low, high = np.searchsorted(splitters, codes, side="left"), np.searchsorted(splitters, codes, side="right")
    return low + ((hashes & _PLACE) % (high - low + 1).astype(np.uint64)).astype(np.int64)


def suffix_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words, by multikey quicksort: only rows still equal are sorted by their next word."""
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    same = np.concatenate([[False], first[1:] == first[:-1]])
    for j in range(1, words.shape[1]):
        tied = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        if not len(tied):
            break
        run = np.cumsum(~same)[tied]
        order[tied] = order[tied][np.lexsort((words[order[tied], j], run))]
        following = words[order[tied], j]
        same[tied] &= np.concatenate([[False], following[1:] == following[:-1]])
    return order


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before it; the first with none."""
    equal = rows[1:] == rows[:-1]
    return np.concatenate([[0], np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))])


def _groups_least(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id among rows with an equal key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    out = np.empty_like(ids)
    out[order] = np.minimum.reduceat(ids[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    return out


_ZSTD = pa.Codec("zstd", compression_level=6)
_squeeze = lambda a: _ZSTD.compress(np.ascontiguousarray(a).tobytes(), asbytes=True)


def _expand(b: bytes, size: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(b, size * kind.itemsize, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


class _Group:
    """Some texts with their anchors, distinct by bucket and key; everything in it follows from texts and splitters."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, blob: bytes, splitters: np.ndarray):
        self.ids, self.ends = ids, np.cumsum(sizes)
        self.data = _expand(blob, int(sizes.sum()), "u1")
        self.place, h, self.first, self.last = anchors(self.data, self.ends)
        self.owner = np.searchsorted(self.ends, self.first, side="right")
        key = h >> np.uint64(24)
        bucket = buckets_of(leading_codes(self.data, self.place), h, splitters)
        both, self.distinct = np.unique(bucket.astype(np.uint64) << np.uint64(40) | key, return_inverse=True)
        self.key, self.bucket = both & np.uint64((1 << 40) - 1), (both >> np.uint64(40)).astype(np.int64)
        lo, hi = np.full(len(both), len(ids)), np.full(len(both), -1)
        np.minimum.at(lo, self.distinct, self.owner)
        np.maximum.at(hi, self.distinct, self.owner)
        self.several = lo != hi

    def flags(self, found: dict[int, bytes]) -> np.ndarray:
        """For each anchor: 0 if alone, 1 if found in two documents, 2 if in very many groups."""
        out = self.several.astype(np.uint8)
        for b, data in found.items():
            a, z = np.searchsorted(self.bucket, [b, b + 1])
            out[a:z] = np.maximum(out[a:z], _expand(data, z - a, "u1"))
        return out[self.distinct]

    def contexts(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors flagged 1: their indexes, each one's distinct context, the contexts' bytes, least ids and buckets.

        A context is the text around an anchor, behind two bytes for the range of starts; zeros where no string reaches.
        """
        at = np.flatnonzero(flags == 1)
        if not len(at):
            return at, at, np.zeros((0, 2 + REACH + LENGTH), np.uint8), at, at
        place, begin, end = self.place[at], self.first[at], self.last[at] + LENGTH
        rows = np.zeros((len(at), 2 + REACH + LENGTH), np.uint8)
        rows[:, 0], rows[:, 1] = place - self.last[at], place - self.first[at]
        for j in range(REACH + LENGTH):
            spot = place + (j - REACH)
            rows[:, 2 + j] = np.where((spot >= begin) & (spot < end), self.data[np.clip(spot, 0, len(self.data) - 1)], 0)
        packed = np.concatenate([self.bucket[self.distinct[at]].astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
        digest = _row_hashes(packed)
        _, pick, row = np.unique(digest, return_index=True, return_inverse=True)
        order = np.argsort(self.bucket[self.distinct[at]][pick], kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        pick, row = pick[order], back[row]
        ids = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(ids, row, self.ids[self.owner[at]])
        return at, row, rows[pick], ids, self.bucket[self.distinct[at]][pick]

    def strings(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors flagged 2: all starts, each one's distinct string, the strings' two hashes and least ids."""
        at = np.flatnonzero(flags == 2)
        n = self.last[at] - self.first[at] + 1
        starts = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(at) else at, n) + np.arange(n.sum())
        h1, h2 = (np.zeros(len(starts), np.uint64) for _ in range(2))
        for j in range(LENGTH):
            byte = _BYTE[self.data[starts + j]]
            h1, h2 = mix(h1 * np.uint64(_BASE) + byte), mix((h2 ^ byte) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
        order = np.lexsort((h2, h1))
        head = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]) if len(order) else np.zeros(0, bool)
        row = np.empty(len(starts), np.int64)
        row[order] = np.cumsum(head) - 1
        pick = order[head]
        ids = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(ids, row, self.ids[np.searchsorted(self.ends, starts, side="right")])
        return starts, row, h1[pick], h2[pick], ids

    def covered(self, flags: np.ndarray, masks: dict[int, bytes], hot: dict[int, bytes], n_hot: int) -> np.ndarray:
        """Whether each byte goes."""
        starts = []
        at, row, contexts, ids, bucket = self.contexts(flags)
        mask = np.zeros(len(contexts), np.uint64)
        for b, data in masks.items():
            a, z = np.searchsorted(bucket, [b, b + 1])
            mask[a:z] = _expand(data, z - a, "<u8")
        mine = self.ids[self.owner[at]]
        every = mine > ids[row]
        for o in range(REACH + 1):
            goes = every | ((mask[row] >> np.uint64(o)) & np.uint64(1)).astype(bool)
            s = self.place[at] - o
            starts.append(s[goes & (s >= self.first[at]) & (s <= self.last[at])])
        if (flags == 2).any():
            begin, row, h1, _, ids = self.strings(flags)
            smaller = np.zeros(len(h1), bool)
            part = (h1 >> np.uint64(32)) % np.uint64(n_hot)
            for b, data in hot.items():
                here = np.flatnonzero(part == b)
                smaller[here] = _expand(data, len(here), "u1").astype(bool)
            mine = self.ids[np.searchsorted(self.ends, begin, side="right")]
            starts.append(begin[(mine > ids[row]) | smaller[row]])
        cover = np.zeros(len(self.data) + 1, np.int32)
        for s in starts:
            np.add.at(cover, s, 1)
            np.add.at(cover, s + LENGTH, -1)
        return np.cumsum(cover)[:-1] > 0


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, by words; used within one group and one bucket only."""
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h = mix(h * np.uint64(_BASE) + words[:, j] + np.uint64(j + 1))
    return h


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in groups: a number, ids, sizes and the compressed bytes. A null id stands in the last column."""
    number = TaskContext.get().partitionId() << 32
    ids, nulls, texts, size = [], [], [], 0

    def group() -> pa.RecordBatch:
        nonlocal number, ids, nulls, texts, size
        row = [[number], [ids], [nulls], [[len(t) for t in texts]], [size], [_ZSTD.compress(b"".join(texts), asbytes=True)]]
        number, ids, nulls, texts, size = number + 1, [], [], [], 0
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["g", "ids", "nulls", "sizes", "size", "blob"])

    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(k if k is not None else 0)
            nulls.append(k is None)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= GROUP_BYTES:
                yield group()
    if texts:
        yield group()


def _members(batch: pa.RecordBatch, splitters: np.ndarray) -> Iterator[tuple[int, _Group, dict]]:
    """The groups of a batch; rows without an id count as empty here, so they neither lose nor cost a byte."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        ids, sizes, nulls = np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64), np.array(row["nulls"], bool)
        blob = row["blob"]
        if nulls.any():
            blob = _squeeze(_expand(blob, int(sizes.sum()), "u1")[np.repeat(~nulls, sizes)])
            sizes = np.where(nulls, 0, sizes)
        yield row["g"], _Group(ids, sizes, blob, splitters), row


def _keys(splitters: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each group by bucket, as sorted 40-bit keys in planes of bytes."""
    for batch in batches:
        for g, group, _ in _members(batch, splitters):
            present, begins, sizes = np.unique(group.bucket, return_index=True, return_counts=True)
            rows = [(b, g, n, _squeeze(group.key[a : a + n].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 4::-1].T)) for b, a, n in zip(present.tolist(), begins.tolist(), sizes.tolist(), strict=True)]
            yield _rows(rows, "bucket", "g", "n", "data")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=list(names))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """From rows sorted by bucket: each bucket's (group, size, data)."""
    now, rows = None, []
    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and rows:
                yield now, rows
                rows = []
            now = b
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket and group, which keys other groups have too."""
    for bucket, rows in _by_bucket(batches):
        keys = np.concatenate([_expand(d, 5 * n, "u1").reshape(5, n).T.astype(np.uint64) @ (np.uint64(256) ** np.arange(4, -1, -1, dtype=np.uint64)) for _, n, d in rows])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        run = np.cumsum(head) - 1
        n = np.bincount(run)[run]
        flag = np.empty(len(keys), np.uint8)
        flag[order] = np.where(n > HOT_GROUPS, 2, n > 1)
        at = np.concatenate([[0], np.cumsum([n for _, n, _ in rows])])
        yield _rows([(bucket, g, n, _squeeze(flag[a : a + n])) for (g, n, _), a in zip(rows, at[:-1], strict=True) if flag[a : a + n].any()], "bucket", "g", "n", "data")



def _contexts(splitters: np.ndarray, n_hot: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors by bucket, and strings of hot ones by hash, in buckets numbered from -1 down."""
    for batch in batches:
        for g, group, row in _members(batch, splitters):
            flags = group.flags({f["bucket"]: f["data"] for f in row["flags"] or ()})
            _, _, contexts, ids, bucket = group.contexts(flags)
            rows = []
            for b in np.unique(bucket).tolist():
                a, z = np.searchsorted(bucket, [b, b + 1])
                rows.append((b, g, z - a, _squeeze(np.concatenate([ids[a:z].astype("<i8").view(np.uint8).reshape(-1, 8), contexts[a:z]], axis=1))))
            if (flags == 2).any():
                _, _, h1, h2, least = group.strings(flags)
                part = (h1 >> np.uint64(32)) % np.uint64(n_hot)
                for b in np.unique(part).tolist():
                    here = part == b
                    rows.append((-1 - b, g, int(here.sum()), _squeeze(np.stack([least[here].view(np.uint64), h1[here], h2[here]], axis=1).astype("<u8"))))
            yield _rows(rows, "bucket", "g", "n", "data")


def smaller_ids(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context a bit for each start: whether a smaller id has the same string around the same anchor."""
    text = contexts[:, 2:]
    suffixes = np.zeros((len(text), 56), np.uint8)
    suffixes[:, :LENGTH] = text[:, REACH:]
    order = suffix_sort(suffixes.view(">u8").astype(np.uint64))
    text, ids, lo, hi = text[order], ids[order], contexts[order, 0], contexts[order, 1]
    common = _common(text[:, REACH:])
    mask, left = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    for o in range(REACH + 1):
        if o:
            left = mix(left * np.uint64(_BASE) + _BYTE[text[:, REACH - o]])
        run = np.cumsum(common < LENGTH - o).astype(np.uint64)
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if len(here):
            least = _groups_least(mix(left[here] + run[here] * np.uint64(0x9E3779B97F4A7C15)), ids[here])
            mask[here[least < ids[here]]] |= np.uint64(1 << o)
    out = np.empty_like(mask)
    out[order] = mask
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket and group: the masks of its contexts, or whether a smaller id has its strings."""
    for bucket, rows in _by_bucket(batches):
        if bucket >= 0:
            width = 10 + REACH + LENGTH
            all_ = np.concatenate([_expand(d, n * width, "u1").reshape(n, width) for _, n, d in rows])
            answer = smaller_ids(all_[:, 8:], np.ascontiguousarray(all_[:, :8]).view("<i8").ravel()).astype("<u8")
        else:
            all_ = np.concatenate([_expand(d, 3 * n, "<u8").reshape(n, 3) for _, n, d in rows])
            ids = all_[:, 0].view(np.int64)
            order = np.lexsort((all_[:, 2], all_[:, 1]))
            h = all_[order, 1:]
            head = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
            least = np.empty_like(ids)
            least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(head))[np.cumsum(head) - 1]
            answer = (least < ids).astype(np.uint8)
        at = np.concatenate([[0], np.cumsum([n for _, n, _ in rows])])
        yield _rows([(bucket, g, n, _squeeze(answer[a : a + n])) for (g, n, _), a in zip(rows, at[:-1], strict=True)], "bucket", "g", "n", "data")


def _cut(splitters: np.ndarray, n_hot: int, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes that go."""
    for batch in batches:
        for _, group, row in _members(batch, splitters):
            flags = group.flags({f["bucket"]: f["data"] for f in row["flags"] or ()})
            masks = {m["bucket"]: m["data"] for m in row["masks"] or ()}
            gone = group.covered(flags, {b: d for b, d in masks.items() if b >= 0}, {-1 - b: d for b, d in masks.items() if b < 0}, n_hot)
            whole = _expand(row["blob"], int(sum(row["sizes"])), "u1") if any(row["nulls"]) else group.data
            out: list[list] = [[] for _ in range(5)]
            at = base = 0
            for k, null, size in zip(row["ids"], row["nulls"], row["sizes"], strict=True):
                text = whole[at : at + size]
                at += size
                cut = np.zeros(size, bool) if null else gone[base : base + size]
                base += 0 if null else size
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                kept = text[~cut].tobytes() if len(edge) else text.tobytes()
                spans = [{"start": a, "stop": z} for a, z in edge.reshape(-1, 2).tolist()]
                for column, x in zip(out, (None if null else k, size, size - len(kept), len(spans) if digests else spans, hashlib.sha256(kept).hexdigest() if digests else kept), strict=True):
                    column.append(x)
            types = [pa.int64()] * 3 + ([pa.int64(), pa.string()] if digests else [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=list("abcde"))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading codes of some anchors of each group."""
    for batch in batches:
        for _, group, _ in _members(batch, np.zeros(0, np.uint64)):
            step = max(1, len(group.place) // SAMPLE_CODES)
            codes = leading_codes(group.data, group.place[step // 2 :: step])
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64))], names=["code"])


def _splitters(groups: DataFrame, n_groups: int, n_buckets: int) -> np.ndarray:
    """The sampled leading codes that part them into n_buckets equal shares, in order; frequent ones come several times.

    The sample grows with the buckets, and its codes are ranked by tasks; eight bytes for each bucket reach the driver.
    """
    wanted = max(SAMPLE_GROUPS, n_buckets // SAMPLE_BUCKETS)
    picked = groups.where(F.pmod(F.xxhash64("g"), F.lit(max(1, n_groups // wanted))) == 0)
    counts = materialize(picked.mapInArrow(_sampled, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n")), "sample")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = materialize(counts.repartitionByRange(1 + distinct // RANKED, "code").withColumn("part", F.spark_partition_id()), "ranges")
    before, ahead = [], 0
    for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each task above
        before.append((r["part"], ahead))
        ahead += r["n"]
    offsets = F.broadcast(groups.sparkSession.createDataFrame(before, "part int, ahead long"))
    rank = F.col("ahead") + F.sum("n").over(Window.partitionBy("part").orderBy("code"))
    share = lambda r: F.least(F.floor(r * n_buckets / max(1, total)), F.lit(n_buckets - 1))
    ranked = ranges.join(offsets, "part").select("code", share(rank - F.col("n")).alias("a"), share(rank).alias("z"))
    found = ranked.where("z > a").select("code", (F.col("z") - F.col("a")).alias("times")).toArrow()
    return np.sort(np.repeat(found["code"].to_numpy(), found["times"].to_numpy())).astype(np.uint64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the id, `n_bytes`, `n_removed`, `spans` (start, stop) and `kept` (bytes), or `n_spans` and `kept_sha256`.

    Ids are whole numbers. A null text counts as empty; a row without an id neither loses bytes nor costs others any;
    rows that share an id aren't smaller than each other. Overlapping repeats inside one document count for others
    only. Strings are judged on the input, not on what is left. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    groups = materialize(rows.mapInArrow(_grouped, "g long, ids array<long>, nulls array<boolean>, sizes array<long>, size long, blob binary"), "groups")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets, n_hot = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // BUCKET_BYTES))
    splitters = _splitters(groups, n, n_buckets) if n_buckets > 1 else np.zeros(0, np.uint64)

    dealt = "bucket long, g long, n long, data binary"
    keys = groups.mapInArrow(lambda b: _keys(splitters, b), dealt)
    flags = keys.repartition("bucket").sortWithinPartitions("bucket", "g").mapInArrow(_repeated, dealt)
    flags = materialize(flags.groupBy("g").agg(F.collect_list(F.struct("bucket", "data")).alias("flags")), "flags")
    flagged = groups.join(flags.hint("shuffle_hash"), "g", "left")
    contexts = flagged.select("g", "ids", "nulls", "sizes", "blob", "flags").mapInArrow(lambda b: _contexts(splitters, n_hot, b), dealt)
    masks = contexts.repartition("bucket").sortWithinPartitions("bucket", "g").mapInArrow(_judged, dealt)
    masks = materialize(masks.groupBy("g").agg(F.collect_list(F.struct("bucket", "data")).alias("masks")), "masks")
    small = flags.join(masks, "g", "full")
    whole = groups.join(small.hint("shuffle_hash"), "g", "left").select("g", "ids", "nulls", "sizes", "blob", "flags", "masks")
    shape = "a long, b long, c long, " + ("d long, e string" if digests else "d array<struct<start:long,stop:long>>, e binary")
    out = whole.mapInArrow(lambda b: _cut(splitters, n_hot, digests, b), shape)
    return out.toDF(id_col, "n_bytes", "n_removed", *(("n_spans", "kept_sha256") if digests else ("spans", "kept")))
