"""op7: one batch of gradient steps against a plain walk over its decisions."""

import math

import numpy as np

from quire.llm import lm_score as lm


def test_digit_steps_equal_a_plain_walk():
    rng = np.random.default_rng(8)
    counts = np.r_[40.0, np.sort(rng.integers(1, 500, 150))[::-1], 7.0]
    shape = lm.classes(counts, rng.integers(0, lm.CLUSTERS, len(counts)))
    bits = 6  # 64 places: most are shared by several decisions of the batch
    model = lm._Model(shape, bits)
    squares = model.parts(np.zeros(len(model.flat), np.float32))
    both, slot = np.zeros(1 << bits, np.complex64), np.full(1 << bits, 12345, np.int32)
    weight, square = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(3):
        keys = np.unique(rng.integers(0, len(counts), 60) << 20 | rng.integers(0, len(counts), 60))
        count = rng.integers(1, 9, len(keys)).astype(np.float32)
        which, digit, odds, place = model.decisions(keys >> 20, keys & lm.LAST)
        gradient = np.zeros(1 << bits)
        for w, d, o, p in zip(which, digit, odds, place):
            gradient[p] += (1 / (1 + math.exp(-(o + weight[p]))) - d) * count[w]
        hit = np.unique(place)
        assert len(hit) < len(place)
        square[hit] += np.abs(gradient[hit]) * np.minimum(np.abs(gradient[hit]), 1)
        weight[hit] -= lm.PAIR_RATE * gradient[hit] / np.sqrt(square[hit] + 1e-6)
        lm._learn_pairs(model, squares, both, slot, keys, count)
        assert np.allclose(both.real, weight, atol=1e-4) and np.allclose(both.imag, square, rtol=1e-4, atol=1e-4)
    assert (np.abs(weight) > 0.01).any()
