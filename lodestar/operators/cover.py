"""Covers: sets of column sets for each right-hand side, as bit masks. Pure Python; everything here is metadata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def bits(mask: int) -> Iterator[int]:
    """The set bits of a mask, from the lowest."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def mask(columns: Iterable[int]) -> int:
    return sum(1 << c for c in set(columns))


def maximal(masks: Iterable[int]) -> set[int]:
    """Those masks of which no other one is a proper superset."""
    out: list[int] = []
    for m in sorted(set(masks), key=int.bit_count, reverse=True):
        if not any(m & ~o == 0 for o in out):
            out.append(m)
    return set(out)


def minimal(masks: Iterable[int]) -> set[int]:
    """Those masks of which no other one is a proper subset."""
    out: list[int] = []
    for m in sorted(set(masks), key=int.bit_count):
        if not any(o & ~m == 0 for o in out):
            out.append(m)
    return set(out)


class CandidateBudgetExceeded(RuntimeError):
    """There are more candidates than the caller allows for. Nothing is dropped in silence."""


class Cover:
    """Left-hand sides by right-hand side, over n columns, up to a largest size."""

    def __init__(self, n: int, max_lhs: int | None = None, budget: int | None = None):
        self.n, self.max_lhs, self.budget = n, max_lhs, budget
        self.sets: list[set[int]] = [set() for _ in range(n)]

    def __len__(self) -> int:
        return sum(map(len, self.sets))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return ((x, rhs) for rhs, s in enumerate(self.sets) for x in s)

    def __contains__(self, fd: tuple[int, int]) -> bool:
        return fd[0] in self.sets[fd[1]]

    @property
    def is_empty(self) -> bool:
        return not len(self)

    @property
    def depth(self) -> int:
        """The size of the largest left-hand side, 0 without any."""
        return max((x.bit_count() for x, _ in self), default=0)

    def add(self, lhs: int, rhs: int) -> bool:
        """Store a dependency; whether it is new. One beyond the largest size isn't stored."""
        if self.max_lhs is not None and lhs.bit_count() > self.max_lhs or lhs in self.sets[rhs]:
            return False
        self.sets[rhs].add(lhs)
        if self.budget is not None and len(self) > self.budget:
            raise CandidateBudgetExceeded(f"more than {self.budget} candidates; lower max_lhs or raise the budget")
        return True

    def add_unless_implied(self, lhs: int, rhs: int) -> bool:
        return not self.has_generalization(lhs, rhs) and self.add(lhs, rhs)

    def add_most_general(self) -> None:
        """The empty set determines every column, until shown otherwise."""
        for rhs in range(self.n):
            self.add(0, rhs)

    def remove(self, lhs: int, rhs: int) -> None:
        self.sets[rhs].discard(lhs)

    def generalizations(self, lhs: int, rhs: int) -> list[int]:
        """Stored subsets of lhs, itself included, from the smallest."""
        return sorted((x for x in self.sets[rhs] if x & ~lhs == 0), key=lambda x: (x.bit_count(), x))

    def generalization(self, lhs: int, rhs: int) -> int | None:
        return next(iter(self.generalizations(lhs, rhs)), None)

    def has_generalization(self, lhs: int, rhs: int) -> bool:
        return any(x & ~lhs == 0 for x in self.sets[rhs])

    def specializations(self, lhs: int, rhs: int) -> list[int]:
        """Stored supersets of lhs, itself included."""
        return sorted(x for x in self.sets[rhs] if lhs & ~x == 0)

    def has_specialization(self, lhs: int, rhs: int) -> bool:
        return any(lhs & ~x == 0 for x in self.sets[rhs])

    def level(self, size: int) -> dict[int, int]:
        """Left-hand sides of a size, with the mask of their right-hand sides."""
        out: dict[int, int] = {}
        for x, rhs in self:
            if x.bit_count() == size:
                out[x] = out.get(x, 0) | 1 << rhs
        return out

    def specialize(self, agree: int, rhs: int) -> int:
        """Two rows agree on `agree` but not on rhs: replace what that refutes by its smallest extensions; how many are new."""
        refuted = self.generalizations(agree, rhs)
        for x in refuted:
            self.remove(x, rhs)
        free = ((1 << self.n) - 1) & ~agree & ~(1 << rhs)
        return sum(self.add_unless_implied(x | 1 << a, rhs) for x in refuted for a in bits(free))

    def refute(self, agree: int) -> int:
        """Use one agree set against every column outside it."""
        return sum(self.specialize(agree, rhs) for rhs in bits(((1 << self.n) - 1) & ~agree))

    def induce(self, agree_sets: Iterable[int]) -> int:
        """Use agree sets, the largest first, since those refute most of what smaller ones would."""
        return sum(self.refute(m) for m in sorted(set(agree_sets), key=int.bit_count, reverse=True))

    def extend(self, lhs: int, rhs: int, column: int) -> int | None:
        """lhs with one more column, unless that can't be a minimal left-hand side of rhs."""
        if column == rhs or lhs >> column & 1 or self.has_generalization(lhs, column) or self.has_generalization(1 << column, rhs):
            return None
        new = lhs | 1 << column
        return None if self.has_generalization(new, rhs) else new

    def trim(self, size: int) -> None:
        """Drop what is larger, and store nothing larger from now on."""
        self.max_lhs = size
        self.sets = [{x for x in s if x.bit_count() <= size} for s in self.sets]

    def minimize(self) -> None:
        self.sets = [minimal(s) for s in self.sets]

    def keep_maximal(self) -> None:
        self.sets = [maximal(s) for s in self.sets]

    def generalize(self) -> None:
        """Replace each left-hand side by those that lack one of its columns."""
        self.sets = [{x & ~(1 << a) for x in s for a in bits(x)} for s in self.sets]

    def grow(self) -> None:
        """Replace each left-hand side by those that have one more column."""
        self.sets = [{x | 1 << a for x in s for a in range(self.n) if a != rhs and not x >> a & 1} for rhs, s in enumerate(self.sets)]
        if self.max_lhs is not None:
            self.trim(self.max_lhs)


def induced(n: int, agree_sets: Iterable[int], max_lhs: int | None = None, budget: int | None = None) -> Cover:
    """The minimal dependencies that a set of agree sets allows for."""
    cover = Cover(n, max_lhs, budget)
    cover.add_most_general()
    cover.induce(agree_sets)
    return cover


def maximal_non_dependencies(n: int, agree_sets: Iterable[int]) -> list[set[int]]:
    """For each column, the largest sets that some pair of rows agrees on while it differs there."""
    sets = set(agree_sets)
    return [maximal(m for m in sets if not m >> rhs & 1) for rhs in range(n)]
