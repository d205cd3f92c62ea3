from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodestar.llm import neardup, suffixes
from lodestar.llm.components import components
from lodestar.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[j:] for j in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def plain_components(rows, size, percent=80):
    sets = [(i, plain_set(t, size)) for i, t in rows if i is not None]
    home = {i: i for i, _ in sets}

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            home[b] = a
    return {i: top(i) for i in home}


def corpus(seed):
    """Unrelated texts, copies, a large group of near copies some of which only link to each other, a common passage."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 7))) for _ in range(400)]
    base = r.choices(vocabulary, k=120)
    passage = " ".join(r.choices(vocabulary, k=60))
    rows = []
    for i in range(60):
        words = base.copy()
        for _ in range(r.randrange(0, 26)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append(" ".join(words))
    for i in range(30):
        rows.append(passage + " " + " ".join(r.choices(vocabulary, k=r.randrange(0, 60))))
    for i in range(30):
        rows.append(" ".join(r.choices(vocabulary, k=r.randrange(0, 9))))
    rows += [None, "", " \n", "One", "one", "one Two", "ONE two", rows[0].upper(), rows[0] + "!", "É x", "é x", "word " * 20000, " ".join(map(str, range(9000))), " ".join(map(str, range(9001)))]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_shingle_sets_are_those_of_the_definition():
    texts = [(t or "").encode() for _, t in corpus(1)]
    for size in (1, 2, 5):
        values, bounds = shingle_sets(texts, size)
        names: dict[int, object] = {}
        for k, t in enumerate(texts):
            mine, plain = values[bounds[k] : bounds[k + 1]], plain_set(t.decode(), size)
            assert len(mine) == len(plain)
        by_set = {}
        for k, t in enumerate(texts):
            by_set.setdefault(plain_set(t.decode(), size), set()).add(values[bounds[k] : bounds[k + 1]].tobytes())
        assert all(len(v) == 1 for v in by_set.values()) and len(set.union(*by_set.values())) == len(by_set), names


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 5), (3, 2)])
def test_components_are_exact(docs_of, by_id, seed, size, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 7)
    rows = corpus(seed)
    got, expected = by_id(neardup.near_duplicates(docs_of(rows), size=size)), plain_components(rows, size)
    for i, t in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(plain_set(t, size)), expected[i], expected[i] == i), t


def test_one_of_each_group_stays(docs_of):
    df = docs_of([(4, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (9, None), (10, None), (4, "a b c d e f")])
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out.collect()) == [(False, 0), (True, 2), (True, 9), (True, 10)]
    marks = [tuple(r) for r in neardup.near_duplicates(df).collect()]
    assert (None, 2, None, True) in marks and marks.count((4, 2, 2, False)) == 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    """Minima and maxima of random sets of similarity 1/3 agree in a third of the values."""
    r = np.random.default_rng(0)
    share = []
    for _ in range(40):
        x = r.integers(0, 2**63, 600, np.uint64)
        a, b = np.sort(x[:400]), np.sort(x[200:])
        sig = neardup.min_max(np.concatenate([a, b]), np.array([0, 400]))
        share.append(np.mean(sig[:, 0] == sig[:, 1]))
    assert abs(np.mean(share) - 1 / 3) < 0.02


@pytest.mark.parametrize("union, common, first", [(5, 4, 0), (6, 5, 1), (10, 8, 1), (15, 12, 3), (25, 20, 2)])
def test_small_sets_at_the_limit_meet(union, common, first):
    """Of 20,000 pairs of few shingles, at a similarity of 0.8 or little more, none misses all bands or fails a sketch.

    A permutation's least and largest value agree together less often than two independent values would, so that
    agreements spread less, and the limits, set by independent ones, are on the safe side.
    """
    n = 20_000
    v = np.random.default_rng(union).integers(0, 1 << 64, (n, union), dtype=np.uint64)
    sides = (v[:, : common + first], np.concatenate([v[:, :common], v[:, common + first :]], axis=1))
    one, two = (neardup.min_max(x.ravel(), np.arange(n) * x.shape[1]) for x in sides)
    assert (one == two).reshape(neardup.BANDS, neardup.BAND, n).all(axis=1).any(axis=0).all()
    bits = [(x * np.uint32(2654435769)) >> np.uint32(31) for x in (one, two)]
    assert (bits[0] == bits[1]).sum(axis=0).min() >= neardup.least_agreement(neardup.PERCENT, 5.5)


def test_components_of_paths_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (60, 50), (60, 55)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 60: 50, 55: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for j in range(len(b) - 49 if i is not None else 0):
            s = b[j : j + 50]
            first[s] = min(first.get(s, i), i)
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - 49 if i is not None else 0):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(8 << 20, 24 << 20, 256), (3000, 5000, 2)])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_exact(spark, docs_of, monkeypatch, seed, sizes):
    """With small groups and buckets and few groups to a hot anchor, all ways of a string through the operator are used."""
    for name, v in zip(("GROUP_BYTES", "BUCKET_BYTES", "HOT_GROUPS"), sizes, strict=True):
        monkeypatch.setattr(suffixes, name, v)
    r = random.Random(seed)
    letters = "abé c"
    passage = "".join(r.choice(letters) for _ in range(130))
    texts = []
    for _ in range(60):
        t = "".join(r.choice(letters) for _ in range(r.randrange(0, 200)))
        for _ in range(r.randrange(3)):
            a = r.randrange(len(passage))
            t += passage[a : a + r.randrange(20, 130)] + r.choice(["", "x", "\n"])
        texts.append(t)
    texts += [None, "", "a" * 49, "a" * 50, "b" * 400, "a" * 60, "ab" * 300, texts[0], texts[1] + texts[2], passage * 40]
    rows = [(r.randrange(1000), t) for t in texts] + [(None, passage), (3, passage), (3, passage), (3, passage + "zz")]
    docs = docs_of(rows).repartition(5)
    got = sorted((tuple(x) for x in suffixes.remove_repeats(docs, digests=True).collect()), key=str)
    assert got == plain_repeats(rows)


def test_repeats_give_spans_and_bytes(docs_of, by_id):
    s = "".join(map(chr, range(40, 120)))
    got = by_id(suffixes.remove_repeats(docs_of([(1, s), (2, "é" + s + "!"), (5, None)])))
    assert [tuple(x) for x in got[2]["spans"]] == [(2, 82)] and bytes(got[2]["kept"]) == "é!".encode() and got[1]["n_removed"] == 0 and got[5]["n_bytes"] == 0
    assert suffixes.remove_repeats(docs_of([(1, s)]).limit(0)).count() == 0


def test_splitters_part_frequent_suffixes_by_hash(spark, docs_of, monkeypatch):
    """Where half of all suffixes begin alike, buckets still get about equal shares, and equal suffixes one bucket each."""
    for name, v in (("GROUP_BYTES", 4000), ("BUCKET_BYTES", 20_000), ("RANKED", 500), ("SAMPLE_BUCKETS", 1)):
        monkeypatch.setattr(suffixes, name, v)
    r = random.Random(5)
    rows = [(k, "".join(r.choices("ABCD" if r.random() < 0.6 else "abcdefgh", k=600))) for k in range(500)]  # A to D have one code
    rows += [(1000 + k, t[r.randrange(300) :] + "end") for k, t in rows[:40]]
    seen = []
    made = suffixes._splitters
    monkeypatch.setattr(suffixes, "_splitters", lambda *a: seen.append((made(*a), a[2])) or seen[-1][0])
    got = sorted((tuple(x) for x in suffixes.remove_repeats(docs_of(rows).repartition(3), digests=True).collect()), key=str)
    assert got == plain_repeats(rows)
    (splitters, n), data = seen[0], np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    assert len(splitters) == n - 1 and (np.diff(splitters.astype(np.int64)) >= 0).all() and len(np.unique(splitters)) < n - 1
    place, h, _, _ = suffixes.anchors(data, np.array([len(data)]))
    codes = suffixes.leading_codes(data, place)
    buckets = suffixes.buckets_of(codes, h, splitters)
    assert (np.diff(buckets[np.argsort(codes, kind="stable")]) < 0).sum() > 0 and np.bincount(buckets).max() < 4 * len(codes) / n
    grams = {}
    for p, b in zip(place.tolist(), buckets.tolist(), strict=True):
        assert grams.setdefault(data[p : p + suffixes.GRAM].tobytes(), b) == b


def test_suffix_sort_is_a_sort():
    r = np.random.default_rng(3)
    words = r.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffixes.suffix_sort(words)
    assert [tuple(w) for w in words[order]] == sorted(tuple(w) for w in words)
