from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.operators.cover import CandidateBudgetExceeded, Cover, bits, induced, mask, maximal, maximal_non_dependencies, minimal
from tests.brute import agree_sets, minimal_fds

RELATIONS = st.integers(1, 5).flatmap(lambda n: st.lists(st.tuples(*[st.sampled_from([None, "a", "b", "c"])] * n), max_size=7).map(lambda rows: (n, rows)))


def named(cover):
    return {(frozenset(str(k) for k in bits(x)), str(a)) for x, a in cover}


def test_subset_lookup():
    c = Cover(5)
    c.add(mask([0, 1, 3]), 2)
    assert not c.has_generalization(mask([0, 1]), 2)
    assert c.generalization(mask([0, 1]), 2) is None
    assert c.generalization(mask([0, 1, 3, 4]), 2) == mask([0, 1, 3])
    assert c.generalizations(mask([0, 1, 3]), 2) == [mask([0, 1, 3])]
    assert c.has_specialization(mask([0, 1]), 2) and c.specializations(mask([0]), 2) == [mask([0, 1, 3])]
    assert not c.has_specialization(mask([4]), 2)
    assert (mask([0, 1, 3]), 2) in c and (mask([0, 1]), 2) not in c


def test_only_maximal_sets_stay():
    c = Cover(5)
    for x in ([0, 1, 3], [0], [1], [1, 4], [4]):
        c.add(mask(x), 2)
    c.keep_maximal()
    assert c.sets[2] == {mask([0, 1, 3]), mask([1, 4])}


def test_growing_and_shrinking():
    c = Cover(4, max_lhs=2)
    assert c.is_empty and c.depth == 0
    assert c.add(mask([0]), 3) and not c.add(mask([0]), 3) and not c.add(mask([0, 1, 2]), 3)
    assert c.level(1) == {1: 8} and c.depth == 1
    c.grow()
    assert c.sets[3] == {mask([0, 1]), mask([0, 2])}
    c.generalize()
    assert c.sets[3] == {1, 2, 4}
    c.minimize()
    assert c.sets[3] == {1, 2, 4}
    c.add(mask([0, 1]), 3)
    c.minimize()
    assert c.sets[3] == {1, 2, 4}
    c.trim(0)
    assert c.is_empty and not c.add(1, 3)


def test_extensions_that_cannot_be_minimal():
    c = Cover(4)
    c.add(mask([0]), 1)
    c.add(mask([2]), 3)
    assert c.extend(mask([0]), 3, 0) is None  # there already
    assert c.extend(mask([0]), 3, 3) is None  # the right side
    assert c.extend(mask([0]), 3, 1) is None  # determined by the left side
    assert c.extend(mask([0]), 3, 2) is None  # determines the right side alone
    assert c.extend(mask([1]), 3, 0) == mask([0, 1])


def test_budget_is_an_error():
    with pytest.raises(CandidateBudgetExceeded):
        induced(6, [mask([0, 1]), mask([2, 3]), mask([4, 5]), 0], budget=8)


def test_maximal_and_minimal():
    assert maximal([1, 3, 4, 7, 8]) == {7, 8}
    assert minimal([1, 3, 4, 7, 8]) == {1, 4, 8}
    assert maximal_non_dependencies(2, [0, 1]) == [{0}, {1}]


@given(RELATIONS, st.booleans(), st.sampled_from([None, 0, 1, 2]))
def test_induction_is_exact(relation, nulls_equal, max_lhs):
    n, rows = relation
    names = [str(k) for k in range(n)]
    assert named(induced(n, agree_sets(rows, nulls_equal), max_lhs)) == minimal_fds(names, rows, nulls_equal, max_lhs)
