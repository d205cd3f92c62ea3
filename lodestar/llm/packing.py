"""Lexical retrieval packing: windows are filled with what a sharded BM25 index finds for their first document.

Documents are tokenized once and sorted by a lexical key, least weighted hashes of their distinct terms, so that near
copies and documents that share rare terms stand close to each other; the order is divided into ranges, and these into
shards of SHARD_TOKENS tokens, so no shard grows with a group of copies or with the rows that repeat an id. A shard holds an inverted index of its documents; the weights of terms, which are
token ids, come from their document counts over all documents. A window's seed is what the last window left of a
document, or else the shard's first unused one; its unused neighbours follow by falling BM25 score, then, where none
shares a term, by id. The document that reaches the window's end is cut there and seeds the next. What a shard's last
window lacks isn't padded: it is cut into sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BATCH_ROWS
from lodestar.llm.shingles import numbers
from lodestar.llm.wordids import word_ids
from lodestar.plans.scratch import materialize

WINDOW = 2048
SHARD_TOKENS = 4_000_000
#: Terms in at least one of so many of a shard's documents have a dense row of weights.
DENSE = 16
K1, B = 1.2, 0.75
#: Rows of weights that are added as they are stored, in 32 bits; their sums are added in 64.
ADDED = 32
#: Neighbours that are put in order at once; a window rarely takes more.
NEAREST = 64
#: Hashes in a document's lexical key, the first of which counts most.
KEYS = 3


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms in order, and how often each is in it."""
    ids = np.sort(ids, kind="stable")  # of 16 bits: by radix
    bounds = np.concatenate([[-1], np.flatnonzero(ids[1:] != ids[:-1]), [len(ids) - 1]])
    return ids[bounds[1:]], bounds[1:] - bounds[:-1]


def _tokenized(path: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's ids with `end` behind them, as bytes; and, in a row without a text, how many texts hold each id, as pairs."""
    words = word_ids(path)
    last, width = np.array([end], words.kind).tobytes(), words.kind.itemsize
    seen = np.zeros(words.library.get_vocab_size() + 1, np.int64)
    ranks = np.ascontiguousarray(lexical_ranks(len(seen)).T.astype(np.int32))
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids = [x + last for x in words.encode([t.as_py() or b"" for t in part.column(1)])]
            terms = [distinct(np.frombuffer(x, words.kind))[0] for x in ids]
            flat, ends = np.concatenate(terms), np.cumsum([len(t) for t in terms])
            seen += np.bincount(flat, minlength=len(seen))
            keys = np.minimum.reduceat(ranks[flat], np.append(0, ends[:-1]), axis=0).T.astype(np.int64)
            n = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64())), part.column(2), *map(pa.array, keys)], names=["k", "n", "ids", "seen", "extra", *(f"l{j}" for j in range(KEYS))])
    if kind is not None:
        some = np.flatnonzero(seen)
        counts = np.stack([some, seen[some]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([counts], pa.list_(pa.int64())), pa.nulls(1, part.column(2).type), *[pa.array([0], pa.int64())] * KEYS], names=["k", "n", "ids", "seen", "extra", *(f"l{j}" for j in range(KEYS))])


def lexical_ranks(size: int) -> np.ndarray:
    """KEYS orders of the terms, each at random but rarer ones first: the least of a document's terms is its hash.

    A term's rank is that of an exponential variable over its weight, the logarithm of its id, as merges are learned from
    the frequent to the rare. Two documents have the same least term with a chance of their weighted similarity.
    """
    out = np.empty((KEYS, size), np.int64)
    for j in range(KEYS):
        u = ((numbers(size, 41 + j) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        out[j, np.argsort(-np.log(u) / np.log(np.arange(size) + 2.0), kind="stable")] = np.arange(size)
    return out


class _Index:
    """A shard's postings: for each term its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = zip(*map(distinct, docs), strict=True)
        sizes = np.array([len(t) for t in terms])
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        flat, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        norm = (K1 * (1 - B + B * np.array([len(d) for d in docs], np.float32) / mean)).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + norm[owner])
        self.terms = terms
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.bounds = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        self.n = len(docs)
        common = np.flatnonzero(np.diff(self.bounds) * DENSE >= self.n)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for k, t in enumerate(common):
            a, b = self.bounds[t], self.bounds[t + 1]
            self.dense[k, self.owner[a:b]] = self.weight[a:b]
        self.live = np.arange(self.n)  # the documents of the dense rows' columns; all unused ones are among them

    def scores(self, seed: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unused documents that share a term with the seed, by place, and their BM25 scores over all its terms."""
        unused = ~used[self.live]
        if 4 * np.count_nonzero(unused) <= 3 * len(unused):
            self.live, self.dense = self.live[unused], np.compress(unused, self.dense, axis=1)
            unused = unused[unused]
        terms = self.terms[seed]
        rows = self.row[terms]
        dense = rows[rows >= 0]
        score = np.zeros(len(self.live))
        for at in range(0, len(dense), ADDED):
            score += self.dense.take(dense[at : at + ADDED], axis=0).sum(axis=0)
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in terms[rows < 0].tolist()]
        if spans:
            score += np.bincount(np.concatenate([self.owner[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.n)[self.live]
        found = np.flatnonzero(unused & (score > 0))
        return self.live[found], score[found]

    def ranked(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by falling score and then place."""
        found, score = self.scores(seed, used)
        return found[np.argsort(-score, kind="stable")]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The same, one by one: the first are put in order by themselves, the rest when it is asked for."""
        found, score = self.scores(seed, used)
        least = np.partition(score, -NEAREST)[-NEAREST] if len(score) > NEAREST else 0
        for part in (score >= least, score < least):
            yield from found[part][np.argsort(-score[part], kind="stable")].tolist()


def windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length): whole windows, then sequences of powers of two."""
    index, used, first = _Index(docs, idf, mean), np.zeros(len(docs), bool), 0
    seed, at = -1, 0
    while True:
        pieces, room = [], window
        queue: Iterator[int] | None = None
        while room:
            if seed < 0:
                seed = next((d for d in queue if not used[d]), -1) if queue is not None else -1
                if seed < 0:
                    while first < len(docs) and used[first]:
                        first += 1
                    if first == len(docs):
                        break
                    seed = first
                used[seed], at = True, 0
            take = min(room, len(docs[seed]) - at)
            pieces.append((seed, at, take))
            room, at = room - take, at + take
            if queue is None and room:
                queue = index.neighbours(seed, used)
            if at == len(docs[seed]):
                seed = -1
        if room:
            break
        yield pieces
    total = window - room
    while total:  # what is left, by its binary digits
        size, out = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            d, start, length = pieces[0]
            take = min(size, length)
            out.append((d, start, take))
            size -= take
            pieces[0] = (d, start + take, length - take)
            if take == length:
                pieces.pop(0)
        yield out


def _packed(width: np.dtype, idf: np.ndarray, mean: float, window: int, most: int, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, ids, extra) in lexical order: the pieces of each shard's sequences."""

    def shard(number: int, keys: list, docs: list[bytes], extras: list, kinds: list) -> pa.RecordBatch:
        arrays = [np.frombuffer(d, width) for d in docs]
        out: list[list] = [[] for _ in range(8)]
        for k, pieces in enumerate(windows(arrays, idf, mean, window)):
            place = 0
            for d, start, length in pieces:
                ids = arrays[d][start : start + length].astype("<u4").tobytes()
                for column, x in zip(out, (keys[d], start, length, zlib.crc32(ids) if digests else ids, len(arrays[d]), number << 32 | k, place, extras[d]), strict=True):
                    column.append(x)
                place += length
        types = [kinds[0], *[pa.int64()] * 2, pa.int64() if digests else pa.binary(), *[pa.int64()] * 3, kinds[1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["k", "start", "length", "ids", "n", "s", "o", "extra"])

    part, number, size, keys, docs, extras, kinds = TaskContext.get().partitionId() << 12, 0, 0, [], [], [], None
    for batch in batches:
        kinds = [batch.schema.field(0).type, batch.schema.field(2).type]
        for k, d, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys.append(k)
            docs.append(d)
            extras.append(e)
            size += len(d) // width.itemsize
            if size >= most:
                yield shard(part + number, keys, docs, extras, kinds)
                number, size, keys, docs, extras = number + 1, 0, [], [], []
    if docs:
        yield shard(part + number, keys, docs, extras, kinds)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", extra_col: str | None = None, window: int = WINDOW, end: int = 1, digests: bool = False) -> DataFrame:
    """Per piece: the id, `start`, `length`, `ids` (little-endian, 32 bits each), `doc_tokens`, `sequence_id`, `offset`.

    A document's ids are those of its whole text, then `end`; a null text counts as empty, so it has one id. With
    digests there is `ids_crc32` for `ids`. `extra_col` is handed on with each piece. Rows that repeat an id, or have
    none, are packed each by itself; an empty table gives no pieces. Each id lies in one piece, and pieces fill a
    sequence from offset 0 without gaps. Texts may be as long as a row can be; columns but `extra_col` are left out.
    """
    spark = docs.sparkSession
    key, extra = F.col(f"`{id_col}`"), F.col(f"`{extra_col}`") if extra_col else F.lit(None).cast("string")
    kind, extra_kind = docs.schema[id_col].dataType.simpleString(), docs.schema[extra_col].dataType.simpleString() if extra_col else "string"
    rows = docs.select(key.alias("k"), F.col(f"`{text_col}`").cast("binary").alias("t"), extra.alias("extra"))
    tokens = materialize(rows.mapInArrow(lambda b: _tokenized(path, end, b), f"k {kind}, n long, ids binary, seen array<long>, extra {extra_kind}, {', '.join(f'l{j} long' for j in range(KEYS))}"), "tokens", BATCH_ROWS)
    n, total = tokens.where("n >= 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = word_ids(path)
    counts = np.zeros(words.library.get_vocab_size() + 1, np.int64)  # one number a token id: bounded by the vocabulary
    for t, c in tokens.where("n < 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("seen") - 2, F.lit(2)), lambda i: F.struct(F.get("seen", i).alias("t"), F.get("seen", i + 1).alias("c")))).alias("p")).groupBy("p.t").agg(F.sum("p.c")).collect():
        counts[t] = c
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    most, mean, width = SHARD_TOKENS, total / max(n, 1), words.kind
    order = [*(f"l{j}" for j in range(KEYS)), "h", "k", "row"]  # `row` parts rows that are equal in all else
    dealt = tokens.where("n >= 0").select("k", "ids", "extra", *order[:KEYS], F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))
    ready = dealt.repartitionByRange(max(1, -(-total // most)), *order).sortWithinPartitions(*order)
    out = ready.select("k", "ids", "extra").mapInArrow(lambda b: _packed(width, shared.value, mean, window, most, digests, b), f"k {kind}, start long, length long, ids {'long' if digests else 'binary'}, n long, s long, o long, extra {extra_kind}")
    names = [id_col, "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset", extra_col or "__extra"]
    return out.toDF(*names) if extra_col else out.toDF(*names).drop("__extra")
