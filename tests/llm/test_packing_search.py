"""Local search ends where no step is left, and loses no piece."""

from __future__ import annotations

import random
import time
from itertools import combinations

import numpy as np
import pytest

from varsparq.llm import packing


def steps_left(lengths, bins, size):
    """Steps of the three kinds that would increase the sum of squared fills, by trying all."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for s, own in enumerate(bins):
        for k, other in enumerate(bins):
            if k == s or fill[k] < fill[s] or fill[s] == size or fill[k] == size:
                continue
            for i in own:
                for back in [(), *combinations(other, 1), *combinations(other, 2)]:
                    gain = lengths[i] - sum(lengths[j] for j in back)
                    if 0 < gain <= size - fill[k]:
                        return s, k, i, back
    return None


@pytest.mark.parametrize("seed", range(12))
def test_no_step_is_left(seed):
    draw = random.Random(seed)
    size = draw.choice([20, 50, 100])
    lengths = np.array([draw.randint(1, draw.choice([size // 3, size // 2, size])) for _ in range(draw.randint(1, 120))])
    bins = [[i] for i in range(len(lengths))] if seed % 2 else packing.best_fit(lengths, size)
    got = packing.local_search(lengths, [list(b) for b in bins], size)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert len(got) <= len(bins) and all(lengths[b].sum() <= size for b in got)
    assert len(got) == -(-lengths.sum() // size) or steps_left(lengths, got, size) is None


def test_exchanges_free_a_bin():
    lengths = np.array([6, 6, 4, 4, 5, 5])
    assert len(packing.local_search(lengths, [[0, 2], [1, 3], [4], [5]], 10)) == 3  # a move
    lengths = np.array([7, 3, 3, 4, 3])  # 7 for 3 and 3: the two shorter ones fit beside the other
    got = packing.local_search(lengths, [[0], [1, 2, 3], [4]], 10)
    assert len(got) == 2


def test_pieces_that_never_fit_are_soon_stuck():
    began = time.process_time()
    got = packing.local_search(np.array([1100 + k % 700 for k in range(20_000)]), [[i] for i in range(20_000)], 2048)
    assert len(got) == 20_000 and time.process_time() - began < 60
