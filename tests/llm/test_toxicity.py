"""FTRL and its features against a plain version, one row and one coordinate after another."""

import math
import random
import re

import numpy as np
import pytest

from severa.llm import hashing, toxicity


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """FTRL-proximal as published, with dictionaries; the bias has no L1."""
    z, n = {}, {}

    def weight(i):
        zi, own = z.get(i, 0.0), 0.0 if i == "bias" else l1
        if abs(zi) <= own and i != "bias":
            return 0.0
        return -(zi - math.copysign(own, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2) if zi else 0.0

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in [*row, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * wi
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.5, 0.1), (3.0, 0.0)])
def test_ftrl_same_as_plain(l1, l2):
    rnd = random.Random(11)
    rows = [sorted(rnd.sample(range(60), rnd.randint(0, 12))) for _ in range(150)]
    labels = [int(7 in r or rnd.random() < 0.1) for r in rows]
    kept, w = toxicity.ftrl([np.array(r, np.int32) for r in rows], np.array(labels), 6, 3, 0.7, 1.0, l1, l2)
    got = {int(i) if i < 64 else "bias": float(x) for i, x in zip(kept, w, strict=True)}
    want = plain_ftrl(rows, labels, 3, 0.7, 1.0, l1, l2)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_features_are_words_neighbours_and_pairs_with_one_between():
    texts = ["a b c a b", "", "a", "c  b\n a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, bounds = toxicity.sets(np.frombuffer(data, np.uint8), offsets, 30)
    sizes = np.diff(bounds).tolist()
    want = []
    for t in texts:
        w = re.findall(r"\S+", t)
        want.append(len({*w, *zip(w, w[1:]), *((a, b, "skip") for a, b in zip(w, w[2:]))}))
    assert sizes == want
    assert len(hashing.words_of(np.frombuffer(data, np.uint8), offsets)[0]) == 9
