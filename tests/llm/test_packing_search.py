"""The filling search of packing against plain enumeration."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gristmill.llm import packing

PIECES = [1028, 926, 926, 816, 714, 612, 408, 408, 306]


def total(plan):
    return sum(n for _, n in plan)


def test_search_backtracks_beyond_the_first_full_filling():
    counts = np.bincount(PIECES, minlength=2049)
    assert total(packing.best_fit(counts, 2048)) == total(packing.completion(counts, 2048)) == 4
    found = packing.search(PIECES, 2048, 3)
    assert sorted(x for p in found for x in p) == sorted(PIECES) and all(sum(p) <= 2048 for p in found)
    assert total(packing.solve(counts, 2048)) == packing.lower_bound(counts, 2048) == 3


def exchanges(fill, unused, room):
    """Whether an unused piece fits in the place of no, one or more smaller pieces of ``fill``."""
    for y in unused:
        for k in range(len(fill) + 1):
            for part in combinations(fill, k):
                if sum(part) <= y and part != (y,) and sum(fill) - sum(part) + y <= room:
                    return True
    return False


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_all_undominated_ones(seed):
    rng = np.random.default_rng(seed)
    items, room = rng.integers(1, 24, 8).tolist(), 40
    for allowed in (0, 3, 40):
        want = set()
        for k in range(9):
            for at in combinations(range(8), k):
                fill = tuple(sorted((items[i] for i in at), reverse=True))
                if room - allowed <= sum(fill) <= room and not exchanges(fill, [items[i] for i in range(8) if i not in at], room):
                    want.add(fill)
        got = list(packing.fillings(np.bincount(items, minlength=65), room, allowed))
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        assert all(not Counter(f) - Counter(items) for f in got)


def fewest(items, capacity):
    """The smallest number of sequences, over all orders of the items by subset."""
    best = [(len(items) + 1, 0)] * (1 << len(items))
    best[0] = (1, 0)
    for subset in range(1 << len(items)):
        n, load = best[subset]
        for i, x in enumerate(items):
            if not subset >> i & 1:
                best[subset | 1 << i] = min(best[subset | 1 << i], (n, load + x) if load + x <= capacity else (n + 1, x))
    return best[-1][0]


def test_small_instances_are_solved_exactly():
    rng = np.random.default_rng(8)
    hard = [40, 13, 42, 29, 23, 44, 14, 45, 30, 31, 28, 43, 18]
    assert total(packing.solve(np.bincount(hard, minlength=101), 100)) == fewest(hard, 100) == 4
    for _ in range(2500):
        capacity = int(rng.choice([20, 50, 100]))
        items = rng.integers(max(1, capacity // int(rng.choice([4, 5, 100]))), capacity // int(rng.choice([1, 2])) + 1, rng.integers(3, 9)).tolist()
        assert total(packing.solve(np.bincount(items, minlength=capacity + 1), capacity)) == fewest(items, capacity), (capacity, items)
