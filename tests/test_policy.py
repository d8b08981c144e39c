import pytest

from tierstone.plans.policy import Policy, make_room
from tierstone.queries import level_shape

LEVELED, TIERED, HYBRID = Policy.LEVELED, Policy.TIERED, Policy.DOSTOEVSKY


@pytest.mark.parametrize("flushes,shape", [(1, [[1]]), (2, [[1], [1]]), (3, [[1], [], [2]]), (4, [[1], [1], [2]]), (5, [[1], [], [], [4]]), (6, [[1], [1], [], [4]]), (8, [[1], [1], [2], [4]]), (9, [[1], [], [], [], [8]])])
def test_ratio_two_is_the_same_for_all_policies(flushes, shape):
    for p in (LEVELED, TIERED, HYBRID):
        assert level_shape(p, 2, flushes) == shape or level_shape(p, 2, flushes) == [*shape, []]


@pytest.mark.parametrize("policy,flushes,shape", [(LEVELED, 3, [[1], [2]]), (TIERED, 3, [[1], [1, 1]]), (HYBRID, 3, [[1], [2]]), (LEVELED, 6, [[1], [2], [3]]), (TIERED, 6, [[1], [1, 1], [3]]), (HYBRID, 6, [[1], [1, 1], [3]]), (TIERED, 9, [[1], [1, 1], [3, 3]]), (HYBRID, 9, [[1], [1, 1], [6]]), (LEVELED, 10, [[1], [], [], [9]])])
def test_ratio_three(policy, flushes, shape):
    assert level_shape(policy, 3, flushes) == shape


def test_empty_merge_empties_the_level():
    class R:
        entries = 1

    levels = [[R()], [R()]]
    make_room(levels, LEVELED, 3, 1, lambda runs, last: None)
    assert levels == [[], []]


def test_no_policy_moves_nothing():
    assert level_shape(Policy.NONE, 2, 4) == [[1, 1, 1, 1]]
