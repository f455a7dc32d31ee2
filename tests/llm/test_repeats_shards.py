"""Shards of op9: which parts need a suffix array, and suffix arrays whose substrings are sorted letter by letter."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomkit.llm import repeats, suffixes


def around(r: random.Random, before: bytes, gram: bytes, after: bytes) -> tuple[bytes, int]:
    other = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    return other(30 - len(before)) + before + gram + after + other(30 - len(after)), 30


def test_parts_with_too_few_bytes_around_the_gram_are_alone():
    r, gram = random.Random(31), b"0123456789abcdefghij"
    for before in range(31):
        for after in range(31):
            left, right = bytes(r.randrange(65, 91) for _ in range(before)), bytes(r.randrange(65, 91) for _ in range(after))
            (a, at), (b, _) = around(r, left, gram, right), around(r, left, gram, right)
            found = repeats.alone([7, 7], [a, b], [at, at]).tolist()
            if before + after >= repeats.LENGTH - repeats.GRAM:
                assert found == [False, False]
            elif before + after < 24:  # such parts went to a suffix array if 16 bytes before or 15 after were equal
                assert found == [True, True]


@pytest.mark.parametrize("dense", [0, 10**9])
def test_suffix_arrays_by_either_sort_of_substrings(dense, monkeypatch):
    monkeypatch.setattr(suffixes, "DENSE", dense)
    r = np.random.default_rng(32)
    for k in range(600):
        n, sigma = int(r.integers(0, 60)), int(r.integers(1, 6))
        s = r.integers(0, sigma, n)
        s = np.tile(s[: max(1, n // 4)], 5)[:n] if k % 3 == 0 else s
        assert suffixes.suffix_array(s, sigma).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
