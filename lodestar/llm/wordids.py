"""Token ids of many texts at once: distinct words are merged together, as arrays, by the tokenizer file's rules.

Texts are split by the classes of their bytes, all at once. A word with a byte that these don't settle (marks, other
scripts, apostrophes, special tokens) stays whole and is split by itself, once for each distinct one.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex

from lodestar.llm.bpe import WordTokenizer, byte_letters

#: Words and pieces kept in a worker's table; a full table is emptied, which costs time but changes nothing.
TABLE_WORDS = 600_000
#: Longer pieces take one round for each merge, so they go one by one through the library.
LONG = 100
_NONE = np.int32(1 << 30)
#: Bytes of text that are split at once, which bounds the arrays; longer texts are cut at white space.
BLOCK = 4_000_000
_SPACE = regex.compile(rb"[\t-\r ]")
_LETTERS = regex.compile("([A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+)([!-/:-@\\[-`{-~]?)")


#: What a byte is: white space, a letter, a digit, a mark of ASCII, or what only the whole word settles.
_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[ord("'")] = _ODD
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER  # U+00C0 to U+00FF; others have an odd byte before
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_KIND, _SMALL = _KIND.tobytes(), _SMALL.tobytes()


def split_all(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 that ends with white space: the pieces, small letters made of capitals, without what is between them;
    where each begins there; where it begins in the data; and whether it is a whole word, which is left as it is.
    """
    data, kind, small = (np.frombuffer(x, np.uint8) for x in (text, bytearray(text).translate(_KIND), bytearray(text).translate(_SMALL)))
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        second = data[lead + 1]
        kind[lead[(second & 0xDF) == 0x97]] = _ODD  # the signs of multiplication and division
        small[lead[second < 0x9F] + 1] |= 0x20
    bars = np.flatnonzero(data == ord("|"))
    kind[bars[(bars > 0) & (data[bars - 1] == ord("<"))]] = _ODD
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        white = np.flatnonzero(kind == _WHITE)
        after = np.searchsorted(white, odd)
        after = after[np.concatenate([[True], after[1:] != after[:-1]])]
        begin, end = np.where(after > 0, white[after - 1] + 1, 0), white[after]
        sizes = end - begin
        inside = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        kind[inside], small[inside] = _ODD, data[inside]
    solid = kind != _WHITE
    starts = solid.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    places = np.flatnonzero(starts)
    return small[solid], np.flatnonzero(starts[solid]), places, kind[places] == _ODD


class _Merges:
    """Ranks and results of pairs, in an open hash table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks, self.made = np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        for (u, v), (rank, w) in pairs.items():
            key = u << 32 | v
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.ranks[at], self.made[at] = key, rank, w

    def find(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Slots of pairs; that of one that is no merge is free."""
        key = u.astype(np.int64) << 32 | v
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return at


def _parts(values: pa.BinaryArray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of the values between each two bounds, joined."""
    if not len(values):
        return [b""] * (len(bounds) - 1)
    to = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)[bounds].tolist()
    raw = values.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]


class WordIds:
    """Encodes texts as the tokenizer file says, without special tokens; ids come as little-endian numbers of `kind`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.kind = np.dtype("<u2" if max(vocab.values()) + len(spec["added_tokens"]) < 1 << 16 else "<u4")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        plain = lambda t: t.removesuffix(suffix)
        merges = self.merges = _Merges({(vocab[a], vocab[b]): (k, vocab[plain(a) + b if a.endswith(suffix) else a + b]) for k, (a, b) in enumerate(model["merges"])})
        second = np.concatenate([self.inner, self.final])
        self.first = merges.find(np.repeat(self.inner, 512), np.tile(second, 256)).astype(np.int32)  # slots of two bytes, the latter as it is within or at the end
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile(b"(" + b"|".join(map(regex.escape, self.special)) + b")")
        self._bytes = {ord(c): chr(b) for b, c in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}

    def split(self, word: bytes) -> tuple[bytes, ...]:
        """The pieces of a word, each of which is merged by itself."""
        if word.isalpha():
            return (word.lower(),)
        if b"<|" in word and self._special.search(word):
            return tuple(p for part in self._special.split(word) if part for p in ((part,) if part in self.special else self.split(part)))
        s = word.decode()
        if m := _LETTERS.fullmatch(s):
            return (m[1].lower().encode(), m[2].encode()) if m[2] else (m[1].lower().encode(),)
        if WordTokenizer.PLAIN.fullmatch(s):
            return tuple(p.encode() for p in WordTokenizer.SPLIT.findall(s.lower()))
        normal = self.library.normalizer.normalize_str(s)
        return tuple(p.translate(self._bytes).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: in each round every piece makes its merge of the lowest rank, wherever it stands."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[data[ends]]
        pair = data.astype(np.int32) << 9
        pair[:-1] += data[1:]
        pair[ends[sizes > 1] - 1] += 256
        slot = self.first[pair]
        rank = self.merges.ranks[slot]
        rank[ends] = _NONE
        owner = np.arange(len(pieces), dtype=np.int32)
        done = []
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            over = low == _NONE
            if over.any():
                out, stay = np.repeat(over, sizes), ~over
                done.append((np.repeat(owner[over], sizes[over]), symbols[out]))
                np.logical_not(out, out=out)
                symbols, rank, slot, low, owner, sizes = symbols[out], rank[out], slot[out], low[stay], owner[stay], sizes[stay]
                if not len(owner):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            near = np.diff(at) == 1
            if near.any():  # of a run of equal letters, every second pair
                head = np.concatenate([[True], ~near])
                at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
            symbols[at] = self.merges.made[slot[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            at -= np.arange(len(at))  # of those before, each has lost one symbol
            symbols, rank, slot = symbols[keep], rank[keep], slot[keep]
            near = np.concatenate([at, at[at > 0] - 1])  # only these have a new neighbour
            slot[near] = self.merges.find(symbols[near], symbols[np.minimum(near + 1, len(symbols) - 1)])
            rank[near] = self.merges.ranks[slot[near]]
            rank[np.cumsum(sizes) - 1] = _NONE
        who, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(who, kind="stable")
        raw, width = ids[order].astype(self.kind).tobytes(), self.kind.itemsize
        to = (np.searchsorted(who[order], np.arange(len(pieces) + 1)) * width).tolist()
        return [raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]

    def look_up(self, words: list[bytes], odd: np.ndarray) -> list[bytes]:
        """The ids of distinct words, of which those at the places `odd` are still to be split."""
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        table = self.table
        if not table:
            for s, i in self.special.items():
                table[s] = np.array([i], self.kind).tobytes()
        found = list(map(table.get, words))
        unknown = [k for k, x in enumerate(found) if x is None]
        split = {words[k]: self.split(words[k]) for k in odd.tolist() if found[k] is None}
        fresh = [w for k in unknown if (w := words[k]) not in split]
        if split:
            fresh = list({*fresh, *(p for ps in split.values() for p in ps if p not in table)})
        for p in [p for p in fresh if len(p) > LONG]:
            table[p] = np.array(self.library.encode(p.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        if short := [p for p in fresh if len(p) <= LONG]:
            table.update(zip(short, self.merge(short), strict=True))
        for w, ps in split.items():
            if w not in table:
                table[w] = b"".join([table[p] for p in ps])
        for k in unknown:
            found[k] = table[words[k]]
        return found

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text of a block."""
        solid, begins, places, whole = split_all(b"\n".join([*texts, b""]))
        bounds = np.concatenate([begins, [len(solid)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
        slots = words.indices.to_numpy()
        distinct = _parts(words.dictionary, np.arange(len(words.dictionary) + 1))
        ids = pa.array(self.look_up(distinct, np.unique(slots[whole])), pa.binary()).take(words.indices)
        return _parts(ids, np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in texts)])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts, which white space of ASCII divides into words."""
        out, block, size = [], [], 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                out += self._block(block)
                block, size = [], 0
            if len(text) <= BLOCK:
                block.append(text)
                size += len(text)
                continue
            parts, at = [], 0
            while at < len(text):
                cut = _SPACE.search(text, at + BLOCK)
                end = cut.end() if cut else len(text)
                parts += self._block([text[at:end]])
                at = end
            out.append(b"".join(parts))
        return out + self._block(block) if block else out


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for a worker."""
    return WordIds(path)
