"""Answers from the definitions, in plain Python."""

from __future__ import annotations

from itertools import combinations


def agree_set(a, b, nulls_equal=True):
    return sum(1 << k for k, (x, y) in enumerate(zip(a, b, strict=True)) if (x == y and (x is not None or nulls_equal)))


def agree_sets(rows, nulls_equal=True):
    return {agree_set(a, b, nulls_equal) for a, b in combinations(rows, 2)}


def minimal_fds(names, rows, nulls_equal=True, max_lhs=None):
    """A set of (frozenset of names, name)."""
    n, pairs = len(names), agree_sets(rows, nulls_equal)
    out = set()
    for a in range(n):
        found = []
        for x in sorted(range(1 << n), key=int.bit_count):
            if x >> a & 1 or (max_lhs is not None and x.bit_count() > max_lhs) or any(y & ~x == 0 for y in found):
                continue
            if not any(x & ~m == 0 and not m >> a & 1 for m in pairs):
                found.append(x)
        out |= {(frozenset(c for k, c in enumerate(names) if x >> k & 1), names[a]) for x in found}
    return out
