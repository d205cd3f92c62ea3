from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from lodestar.llm import bpe, counts, packing
from lodestar.llm.wordids import WordIds, word_ids

TEXTS = [None, "", " \n\t", "Hello, world! it's we'll 'S 12345", "aaaaaaa aaa aaaaaaaaaaaaaa", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "İSTANBUL ΣΑΣ ß H̱ ẖ T̈ é é", "日本語 😀😀 a b c", "x" * 3000, "ab" * 200 + "...,,, a.b. c, d", "naïve café – œuvre ŒUVRE", "\x00\x1c\x7f\x85"]
ANY = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeé ,.'<|>STst\n")), max_size=60)


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(ANY)
@settings(max_examples=300, deadline=None)
def test_both_encoders_match_the_library(text):
    from lodestar.llm.queries import WORD_BPE, tokenizer_file

    path = tokenizer_file(WORD_BPE)
    expected = ids_of(_library(path), text)
    words = bpe.tokenizer(path)
    assert [i for w in text.encode().split() for i in words.word(w.decode())] == expected
    fast = word_ids(path)
    assert np.frombuffer(fast.encode([text.encode()])[0], fast.kind).tolist() == expected


_CACHE = {}


def _library(path):
    return _CACHE.setdefault(path, Tokenizer.from_file(path))


def test_automaton_arcs_are_the_merges_answer():
    """On a small alphabet: a pair of tokens has an arc if and only if merging their letters gives that pair."""
    merges = [("a", "b"), ("ab", "a"), ("a", "a"), ("b", "b"), ("ab", "ab")]
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", *("".join(m) for m in merges)])}
    auto = bpe.MergeAutomaton(vocab, merges, "</w>")
    ranks = {m: k for k, m in enumerate(merges)}

    def merged(s):
        parts = [*s[:-1], s[-1] + "</w>"]
        while True:
            best = min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    r = random.Random(1)
    for _ in range(2000):
        s = "".join(r.choice("ab") for _ in range(r.randrange(1, 14)))
        assert auto.encode(s) == merged(s), s
    with pytest.raises(ValueError):
        auto.encode("c")


def test_encode_decode_operator(spark, docs_of, by_id, word_bpe, library):
    df = docs_of(list(enumerate(TEXTS)))
    got, digests = by_id(bpe.encode_decode(df, word_bpe)), by_id(bpe.encode_decode(df, word_bpe, digests=True))
    for i, t in enumerate(TEXTS):
        ids = ids_of(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"]) == (ids, decoded), t
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(digests[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    assert bpe.encode_decode(df.limit(0), word_bpe).count() == 0
    assert bpe.encode_decode(df.union(df), word_bpe).count() == 2 * len(TEXTS)


def test_full_tables_change_nothing(word_bpe, library, monkeypatch):
    monkeypatch.setattr("lodestar.llm.wordids.TABLE_WORDS", 3)
    words = WordIds(word_bpe)
    texts = [t for t in TEXTS if t]
    for t in texts * 2:
        assert np.frombuffer(words.encode([t.encode()])[0], words.kind).tolist() == ids_of(library, t)


def test_trie_counts_match_a_plain_forward_pass(pieces):
    scores = counts.unigram(pieces)
    lowest = min(scores.values()) - counts.UNKNOWN

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            top = None
            for j in range(i):
                piece = word[j:i]
                score = scores.get(piece, lowest if i - j == 1 else None)
                if score is None:
                    continue
                n = 1 if piece in scores else len(piece.encode())
                if top is None or best[j][0] + score > top[0]:
                    top = (best[j][0] + score, best[j][1] + n)
            best.append(top)
        return best[-1][1]

    trie = counts.PrefixTrie(scores)
    words = ["hello", "hell", "helium", "x", "", "日本", "naïveté", "aaaaaaaaaaaaaaaa", "\U0001f600\U0001f600", "internationalization"]
    for w in words + sorted(words):
        assert trie.add(counts.MARK + w) == plain(counts.MARK + w), w
    known = [w for w in words if all(c in scores for c in w)]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], unk_id=0, byte_fallback=False))
    assert [trie.add(counts.MARK + w) for w in known] == [len(model.encode(counts.MARK + w).ids) for w in known]


def test_token_count_operator(docs_of, by_id, pieces, monkeypatch):
    df = docs_of([*enumerate(TEXTS), (50, "a b a"), (51, "word " * 4000)])
    got = by_id(counts.count_tokens(df, pieces))
    one = counts.PrefixTrie(counts.unigram(pieces))
    for i, t in [*enumerate(TEXTS), (50, "a b a"), (51, "word " * 4000)]:
        words = (t or "").encode().split()
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(one.add(counts.MARK + w.decode()) for w in words)), t
    assert counts.count_tokens(df.limit(0), pieces).count() == 0


def check_pieces(rows, ids, window=2048):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert docs.keys() == ids.keys()
    for d, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window
    return sequences


@pytest.mark.parametrize("shard", [packing.SHARD_TOKENS, 3000])
def test_packing_places_every_id_once(docs_of, word_bpe, library, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    texts = [*TEXTS, *(" ".join(r.choices(vocabulary, k=r.randrange(0, 900))) for _ in range(40)), "same copy " * 50, "same copy " * 50, "long " * 7000]
    rows = packing.pack(docs_of(list(enumerate(texts))), word_bpe, digests=True).collect()
    sequences = check_pieces(rows, {i: [*ids_of(library, t), 1] for i, t in enumerate(texts)})
    assert len({s >> 32 for s in sequences}) > 1 or shard > 3000


def test_windows_follow_scores():
    """Two topics: a window holds its seed and then what shares its terms, before anything else."""
    docs = [np.array([10 + k % 2] * 3 + [20 + k, 1], np.uint16) for k in range(12)]
    df = np.zeros(64)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (12 - df + 0.5) / (df + 0.5)).astype(np.float32)
    first = next(packing.windows(docs, idf, 5.0, window=32))
    assert [d for d, _, _ in first][:6] == [0, 2, 4, 6, 8, 10] and sum(n for _, _, n in first) == 32


def test_packing_of_odd_tables(docs_of, word_bpe):
    df = docs_of([(None, None), (None, "a"), (3, "a"), (3, "a")])
    out = packing.pack(df, word_bpe, extra_col="source")
    assert sum(r["length"] for r in out.collect()) == 1 + 2 + 2 + 2 and "source" in out.columns
    assert packing.pack(df.limit(0), word_bpe).count() == 0


def test_neighbours_are_ranked_by_all_terms():
    """Documents of some 60 terms, against plain BM25 over every term of the seed."""
    r = np.random.default_rng(3)
    docs = [np.concatenate([r.choice(400, 60), r.choice(20, 20)]).astype(np.uint16) for _ in range(50)]
    df = np.zeros(401)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (50 - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing._Index(docs, idf, 80.0)
    for seed in range(5):
        used = np.arange(50) == seed
        plain = np.array([0 if used[k] else sum(idf[t] * c * (packing.K1 + 1) / (c + packing.K1) for t in set(docs[seed].tolist()) if (c := int((d == t).sum()))) for k, d in enumerate(docs)])
        got = index.ranked(seed, used)
        assert sorted(got) == np.flatnonzero(plain).tolist() and np.allclose(plain[got], np.sort(plain[plain > 0])[::-1], atol=1e-4)


def test_arcs_are_what_the_merges_leave(word_bpe, library):
    """The compiled table against the merges replayed on pairs of tokens; every prefix of a word has one path."""
    auto = bpe.tokenizer(word_bpe).automaton
    r, tokens = random.Random(7), list(auto.tokens.items())
    inner = [t for t in tokens if not t[0].endswith("")]
    pairs = [(r.choice(inner)[1], r.choice(tokens)[1]) for _ in range(3000)] + [(u, v) for u, v in list(auto.rank)[::40] if u in auto.spelled and v in auto.spelled]
    plain = [auto._meet(t, u) and (t, u) not in auto.rank for t, u in pairs]
    assert auto.have_arcs(*(np.array(x) for x in zip(*pairs, strict=True))).tolist() == plain and 0 < sum(plain) < len(plain)
    words = ["".join(r.choice("etaoinshrdluaaee") for _ in range(r.randrange(1, 30))) for _ in range(400)] + ["x" * 3000, "ab" * 60, "é", ""]
    words = [w for w in words if w]
    letters = [p for w in words for p, _ in library.pre_tokenizer.pre_tokenize_str(w)]
    got = auto.encode_all(letters)
    assert got == [auto.encode(x) for x in letters] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert auto.encode_all([]) == []


def test_rows_without_an_id_are_spread_and_neighbours_meet(spark, word_bpe, monkeypatch):
    """Many rows of one id, or none, fill many shards; near copies share a shard far more often than by chance."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2500)
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(2000)]
    texts = [" ".join(r.choices(vocabulary, k=40)) for _ in range(100)]
    rows = [(None, t, "") for t in texts] + [(k, t + " " + r.choice(vocabulary), "") for k, t in enumerate(texts)] + [(7, "same", "")] * 3000
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, __t string"), word_bpe).collect()
    shards = {}
    for x in out:
        shards.setdefault(x["sequence_id"] >> 32, []).append(x)
    assert len({x["sequence_id"] >> 32 for x in out if x["doc_id"] is None}) > 4
    assert max(sum(x["length"] for x in xs) for xs in shards.values()) < 2 * 2500 and len(shards) > 8
    place = {}
    for x in out:
        if x["start"] == 0 and x["doc_id"] != 7 or x["doc_tokens"] > 10 and x["start"] == 0:
            place.setdefault(bytes(x["ids"])[:20], set()).add(x["sequence_id"] >> 32)
    assert sum(len(v) == 1 for v in place.values()) > 0.7 * len(place)


def test_plain_words_are_split_by_their_bytes(word_bpe, library, monkeypatch):
    """op6's check finding: words of ASCII and Latin-1 letters, digits and marks cost no call each."""
    words = WordIds(word_bpe)
    text = "Éàß ÀÉÞÿ fünf, 12x3 (a.b)... don-nez\tHELLO\nworld! a<b||c " * 3
    monkeypatch.setattr(WordIds, "split", None)
    assert np.frombuffer(words.encode([text.encode()])[0], words.kind).tolist() == ids_of(library, text)


@pytest.mark.parametrize("block", [7, 4_000_000])
def test_words_that_bytes_do_not_settle(word_bpe, library, monkeypatch, block):
    """Random texts of both kinds of words, in blocks that end within texts, between them and in neither."""
    monkeypatch.setattr("lodestar.llm.wordids.BLOCK", block)
    words, r = WordIds(word_bpe), random.Random(4)
    parts = [*"abETs'.,<|>19_ \n\té×÷ßÞÿÀ", "\x00", "\x1c", "\x7f", "\x85", "\xa0", "\u0301", "İ", "ſ", "日", "ª", "😀", "<|endoftext|>", "'s", "'LL", "\u2009", "H\u0331", "ab" * 60]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(1500)] + [" ", ""]
    got = words.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, words.kind).tolist() for x in got] == [ids_of(library, t) for t in texts]
    assert words.encode([]) == []


def test_neighbours_come_in_order_and_used_documents_leave_the_index(monkeypatch):
    """op6's check finding: weights of used documents are no longer added; what is left is ranked as before."""
    monkeypatch.setattr(packing, "NEAREST", 3)
    r = np.random.default_rng(5)
    docs = [r.choice(300, 70).astype(np.uint16) for _ in range(60)] + [np.arange(5, dtype=np.uint16)] * 8
    idf = np.linspace(0.5, 4, 301).astype(np.float32)
    index, used = packing._Index(docs, idf, 70.0), np.zeros(len(docs), bool)
    for seed in r.permutation(len(docs)).tolist():
        used[seed] = True
        plain = packing._Index(docs, idf, 70.0).ranked(seed, used).tolist()
        assert list(index.neighbours(seed, used)) == index.ranked(seed, used).tolist() == plain
        assert index.dense.shape[1] <= 4 / 3 * np.count_nonzero(~used) + 1
