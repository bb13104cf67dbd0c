"""Budgets of sources with few and long documents."""

import random

import numpy as np

from severa.llm.source_mix import fit


def near(lengths, counts, budget):
    take = fit(np.array(lengths), np.array(counts), budget)
    assert (take >= 0).all() and (take <= counts).all()
    return int((take * lengths).sum())


def test_few_long_documents():
    assert near([17_000, 18_000, 20_000], [1, 1, 1], 38_000) == 38_000
    assert near([15_000, 20_000], [2, 2], 40_000) == 40_000
    assert near([1_700_003, 1_800_001, 2_000_009], [1, 1, 1], 3_800_010) == 3_800_010
    rnd = random.Random(3)
    for at_most in (90_000, 900_000):
        for _ in range(40):
            lengths = sorted(rnd.sample(range(at_most // 9, at_most // 3), rnd.randint(1, 6)))
            counts = [rnd.randint(1, 3) for _ in lengths]
            budget = rnd.randint(0, at_most)
            reach = {0}
            for n, c in zip(lengths, counts, strict=True):
                reach = {r + n * j for r in reach for j in range(c + 1) if r + n * j <= budget}
            assert near(lengths, counts, budget) == max(reach)


def test_many_lengths_above_the_grid():
    rnd = random.Random(4)
    lengths = sorted(rnd.sample(range(10_000, 3_000_000), 60))
    counts = [rnd.randint(1, 5) for _ in lengths]
    budget = int(0.4 * sum(n * c for n, c in zip(lengths, counts, strict=True)))
    assert budget - near(lengths, counts, budget) <= 100
    assert near([2, 3, 5, *range(7, 3000)], [50_000] * 2996, 10**10 + 7) == 10**10 + 7
