"""BPE by an automaton over tokens: compiled from the merges, run by tables, decoded by its arcs' labels.

States are the tokens, and a start; reading a token leads to its state. The automaton begins with the letters, and all
arcs between them; each merge (u, v) -> w, in rank order, is a gadget on it: the arcs from u to v are cut, as that pair
would have been merged, and w takes over the arcs that lead to u and those that leave v. What is left accepts a string's
tokens if and only if they are what the merges make of it.

All arcs would be some billions, but they needn't be spelled out. Who takes over u's arcs forms a tree (a token's left
part is its parent), and who takes over v's another. If both are numbered in preorder, with children born later first,
then what a merge cuts, in the automaton that all later gadgets leave, is one range of states times one range of tokens.
So a state's row is its default, an arc to every token, and the sorted ranges of tokens that are cut: a few million
ranges in all. Every prefix of a word has just one path, hence the automaton is run forward, letter by letter, without
stepping back: the state behind a prefix is the one token that ends there and has an arc from the state before it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shingles import mix, numbers

#: Words kept in a worker's table; a full table is emptied, which costs time but changes nothing.
TABLE_WORDS = 400_000
#: Longer pieces are run one by one.
LONG = 48
_NEVER = 1 << 60
_BASE = 0xA24BAED4963EE407
#: A number for each letter, which are bytes, and behind them each as a word's last.
_LETTER = numbers(512, 31)
_STOP, _COMMA = (re.compile(rb"%b(?=[ \n])(?<=[a-z]%b)" % (c, c)) for c in (rb"\.", b","))
#: Stands for the end-of-word suffix, as one character.
_END = "\ue000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class MergeAutomaton:
    """The automaton of a list of merges, for words that end with a suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        inner = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        tokens = {inner(t): i for t, i in vocab.items()}
        self.labels = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        made = {t: i for t, i in tokens.items() if len(t.replace(_END, "")) == 1}
        self.born |= dict.fromkeys(made.values(), -1)
        for k, (a, b) in enumerate(merges):
            u, v, w = tokens[inner(a)], tokens[inner(b)], tokens[inner(a + b)]
            if w in self.born or u not in self.born or v not in self.born:
                raise ValueError(f"{a + b!r} is made by two merges, or of parts that come later")
            self.rank[u, v] = k
            self.parts[w], self.born[w] = (u, v), k
            if inner(a) in made and inner(b) in made and self._meet(u, v):  # else nothing is ever merged to w
                made[inner(a + b)] = w
        self.tokens = made
        self.longest = max(len(t.replace(_END, "")) for t in made)
        self._compile()
        self._arcs: dict[int, bool] = {}
        self._index(byte_letters())

    def _spine(self, t: int, side: int) -> list[int]:
        """A letter at that side of t, and what it grows into until it is t."""
        out = [t]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def _meet(self, t: int, u: int) -> bool:
        """Whether the gadgets so far leave t and u whole beside each other, but for the merge of the two."""
        left, right = self._spine(t, 1), self._spine(u, 0)
        i = j = 0
        while i + 1 < len(left) or j + 1 < len(right):
            grow_i = self.born[left[i + 1]] if i + 1 < len(left) else _NEVER
            grow_j = self.born[right[j + 1]] if j + 1 < len(right) else _NEVER
            across = self.rank.get((left[i], right[j]), _NEVER)
            if across < grow_i and across <= grow_j:  # of equal merges the one further left comes first
                return False
            if grow_i <= grow_j:
                i += 1
            else:
                j += 1
        return True

    def _compile(self) -> None:
        """Apply the merges' gadgets in rank order: each state's ranges of tokens to which its arcs are cut, in one table."""
        heirs: dict[int, list[int]] = {}
        for w, (u, _) in self.parts.items():  # in rank order
            heirs.setdefault(u, []).append(w)
        self.place = np.zeros(max(self.born) + 1, np.int64)
        end, n = {}, 0
        stack = [(t, False) for t in reversed([t for t in self.born if t not in self.parts])]
        while stack:  # preorder of the tree of left parts, later children first
            t, done = stack.pop()
            if done:
                end[t] = n
                continue
            self.place[t], n = n, n + 1
            stack.append((t, True))
            stack += [(c, False) for c in heirs.get(t, ())]
        cuts: dict[int, tuple[list[int], list[int], list[int]]] = {}
        births = {u: [self.born[c] for c in cs] for u, cs in heirs.items()}
        for (u, v), k in self.rank.items():
            later = bisect.bisect_left(births.get(v, []), k)  # v's heirs from here on are born with this merge or later
            ranks, begins, stops = cuts.setdefault(u, ([], [], []))
            ranks.append(k)
            begins.append(int(self.place[v]))
            stops.append(end[heirs[v][later]] if later < len(births.get(v, ())) else int(self.place[v]) + 1)
        arrays = {u: (np.array(r), np.array(b), np.array(s)) for u, (r, b, s) in cuts.items()}
        owner, begins, stops = [], [], []
        for t in self.tokens.values():
            following = _NEVER
            for x in reversed(self._spine(t, 1)):
                if x in arrays:
                    ranks, b, s = arrays[x]
                    m = bisect.bisect_left(cuts[x][0], following)
                    owner.append((t, m))
                    begins.append(b[:m])
                    stops.append(s[:m])
                following = self.born[x]
        t = np.repeat(*(np.array(c, np.int64) for c in zip(*owner, strict=True)))
        begin, stop = t << 32 | np.concatenate(begins), t << 32 | np.concatenate(stops)
        order = np.lexsort((-stop, begin))
        begin, stop = begin[order], stop[order]
        fresh = np.concatenate([[True], stop[1:] > np.maximum.accumulate(stop)[:-1]])  # ranges lie apart or in each other
        self.begins, self.stops = begin[fresh], stop[fresh]

    def have_arcs(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Whether arcs lead from states t to states u, by the table."""
        at = t << 32 | self.place[u]
        row = np.searchsorted(self.begins, at, side="right") - 1
        return (row < 0) | (at >= self.stops[row])

    def arc(self, t: int, u: int) -> bool:
        key = t << 32 | u
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > 500_000:
                self._arcs.clear()
            found = self._arcs[key] = bool(self.have_arcs(np.array([t]), np.array([u]))[0])
        return found

    def encode(self, letters: str) -> list[int]:
        """The labels of the one path that spells a word."""
        n, tokens = len(letters), self.tokens
        state: list[int] = []
        for p in range(1, n + 1):
            s = letters + _END if p == n else letters
            for size in range(1, min(p, self.longest) + 1):
                t = tokens.get(s[p - size : p + (p == n)])
                if t is not None and (size == p or self.arc(state[p - size - 1], t)):
                    state.append(t)
                    break
            else:
                raise ValueError(f"no token for {letters!r}")
        return self._path(state)

    def _path(self, state: list[int]) -> list[int]:
        out, p = [], len(state)
        while p:
            out.append(state[p - 1])
            p -= self.sizes[state[p - 1]]
        return out[::-1]

    def _index(self, letters: list[str]) -> None:
        """Tokens by hashes of their letters, in an open table; what it finds is compared with the word in the end."""
        byte = {c: b for b, c in enumerate(letters)}
        self.bytes = {c: chr(b) for c, b in zip(map(ord, letters), range(256), strict=True)}
        self.sizes = {i: len(t.replace(_END, "")) for t, i in self.tokens.items()}
        self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(LONG, _BASE, np.uint64))])
        self.bits = (8 * len(self.tokens)).bit_length()
        self.keys, self.found = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        self.spelled: dict[int, bytes] = {}
        for t, i in self.tokens.items():
            if all(c in byte for c in t.replace(_END, "")):
                raw = t.translate(self.bytes).replace(_END, "").encode("latin-1")
                self.spelled[i] = raw
                symbols = np.frombuffer(raw, np.uint8).astype(np.int64)
                symbols[-1] += 256 * t.endswith(_END)
                if len(symbols) <= LONG:
                    key = mix(np.array([(_LETTER[symbols] * self.up[: len(symbols)]).sum()]))[0]
                    at = int(key >> np.uint64(64 - self.bits))
                    while self.keys[at]:
                        at = (at + 1) % len(self.keys)
                    self.keys[at], self.found[at] = key, i

    def _tokens_at(self, h: np.ndarray) -> np.ndarray:
        """Tokens by hash, -1 for none."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            open_ = open_[(seen != h[open_]) & (seen != 0)]
        return np.where(self.keys[at] == h, self.found[at], -1)

    def encode_all(self, pieces: list[str]) -> list[list[int]]:
        """The paths of many words, run together: at each letter, of the tokens that end there, the one with an arc."""
        raw = [p.translate(self.bytes).encode("latin-1") if len(p) <= LONG else b"" for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        words = int(np.searchsorted(-sizes, 0))
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(raw[k] for k in order[:words]), np.uint8).astype(np.int64)
        symbols[(starts + sizes)[:words] - 1] += 256
        state = np.full(len(symbols), -1, np.int64)
        for p in range(1, int(sizes[0]) + 1 if words else 0):
            here = int(np.searchsorted(-sizes, -p, side="right"))  # words of so many letters at least
            open_, h = starts[:here] + p, np.zeros(here, np.uint64)
            for size in range(1, min(p, self.longest) + 1):
                h = h * np.uint64(_BASE) + _LETTER[symbols[open_ - size]]
                t = self._tokens_at(mix(h))
                ok = t >= 0
                if size < p and ok.any():
                    at = np.flatnonzero(ok)
                    ok[at] = self.have_arcs(state[open_[at] - size - 1], t[at])
                state[open_[ok] - 1] = t[ok]
                open_, h = open_[~ok], h[~ok]
                if not len(open_):
                    break
        out: list[list[int]] = [[]] * len(pieces)
        flat, spelled = state.tolist(), self.spelled
        for k, a, n in zip(order.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            path = flat[a : a + n]
            found = self._path(path) if n and -1 not in path else []
            out[k] = found if found and b"".join([spelled[t] for t in found]) == raw[k] else self.encode(pieces[k])
        return out


class WordTokenizer:
    """Pre-splits texts as the tokenizer file says and encodes words by the automaton."""

    #: Characters whose normal form and lower case need no table: printable Latin without marks and without U+0130.
    PLAIN = regex.compile("[!-~\xa1-įı-ſ]+")
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._letters = byte_letters()
        self._pieces: dict[str, list[int]] = {}

    def split(self, word: str) -> list[str | int]:
        """The pieces of a string without white space at its ends, as letters; strings of special tokens give their ids."""
        if "<|" in word and self._special.search(word):
            return [x for part in self._special.split(word) if part for x in ([self.special[part]] if part in self.special else self.split(part))]
        if self.PLAIN.fullmatch(word):
            low = word.lower()
            parts = self.SPLIT.findall(low)
            return parts if low.isascii() else ["".join(map(self._letters.__getitem__, p.encode())) for p in parts]
        return [p for p, _ in self.pre_split(self.normalize(word))]

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each of some strings without white space at their ends; pieces that are new are run together."""
        split = [self.split(w) for w in words]
        if len(self._pieces) >= TABLE_WORDS:
            self._pieces.clear()
        fresh = [p for p in dict.fromkeys(p for ps in split for p in ps if isinstance(p, str)) if p not in self._pieces]
        self._pieces.update(zip(fresh, self.automaton.encode_all(fresh), strict=True))
        return [[i for p in ps for i in ([p] if isinstance(p, int) else self._pieces[p])] for ps in split]

    def word(self, word: str) -> list[int]:
        return self.words([word])[0]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One automaton for a worker."""
    return WordTokenizer(path)


def small_words(text: bytes) -> list[bytes]:
    """A text's words, divided by white space of ASCII.

    Where no mark, whose composition may hang on the case, and no special token can be in it, letters of ASCII are made
    small first, and a full stop or comma between a letter and white space, a piece by itself, becomes a word.
    """
    if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
        text = _COMMA.sub(b" ,", _STOP.sub(b" .", text.lower()))
    return text.split()


def encoded(path: str, batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    """From batches of (key, text as bytes): the key with ids and decoded text, or with their count and digests."""
    words = tokenizer(path)
    number = {i: b"%d " % i for i in words.labels}
    label = {i: t.encode() + b" " for i, t in words.labels.items()}
    forms: dict[bytes, tuple[bytes, bytes]] = {}
    for batch in batches:
        texts = [small_words(text.as_py() or b"") for text in batch.column(1)]
        if len(forms) >= TABLE_WORDS:
            forms.clear()
        fresh = list(set().union(*texts) - forms.keys())
        for w, ids in zip(fresh, words.words([w.decode() for w in fresh]), strict=True):
            forms[w] = b"".join(map(number.__getitem__, ids)), b"".join(map(label.__getitem__, ids))
        rows = []
        for text in texts:
            found = [forms[w] for w in text]
            ids, decoded = b"".join([x[0] for x in found]), b"".join([x[1] for x in found])[:-1]
            rows.append((ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else ([int(i) for i in ids.split()], decoded.decode()))
        types = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", *"abc"[: len(columns)]])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the id, `ids` and `decoded`, the labels of its arcs; or `n_tokens`, `ids_sha256`, `decoded_sha256`.

    Special tokens aren't added, but their strings in a text give their ids. A null text counts as empty, without ids.
    Each row stands for itself, so repeated rows are repeated in the result; other columns are left out, so that no name
    clashes. Empty tables give no rows; a text may be as long as a row can be.
    """
    key = docs.schema[id_col].dataType.simpleString()
    shape = "a long, b string, c string" if digests else "a array<int>, b string"
    df = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    out = df.mapInArrow(lambda batches: encoded(path, batches, digests), f"k {key}, {shape}")
    return out.toDF(id_col, *(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))
