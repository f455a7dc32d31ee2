"""Near-duplicates that five-word shingles or the least node of a bucket would lose, against brute force."""

from __future__ import annotations

import random

from loomkit.llm import neardup
from loomkit.llm.common import words


def edited(w: list[str], edits: int, r: random.Random) -> list[str]:
    w = list(w)
    for _ in range(edits):
        at, kind = r.randrange(len(w)), r.choice("sid")
        w[at : at + (kind != "i")] = [] if kind == "d" and len(w) > 1 else [f"n{r.randrange(10**6)}"]
    return w


def plain_classes(rows: list[tuple[int, str]]) -> list[tuple[int, int]]:
    found, root = [(d, words(t)) for d, t in rows], {d: d for d, _ in rows}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(found):
        for e, b in found[:i]:
            if neardup.similar(a, b):
                x, y = sorted((top(d), top(e)))
                root[y] = x
    return [(d, top(d)) for d, _ in rows]


def classes(spark, rows):
    return sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_short_keys_miss_no_similar_pair():
    r, n = random.Random(11), 0
    while n < 3000:
        a = [f"w{r.randrange(40)}" for _ in range(r.randint(1, neardup.SHORT))]
        b = edited(a, r.randint(1, 6), r)
        x, y = ([w.encode() for w in t] for t in (a, b))
        if a != b and len(b) <= neardup.SHORT and neardup.similar(x, y):
            n += 1
            assert set(neardup.short_keys(neardup.word_hashes(x))) & set(neardup.short_keys(neardup.word_hashes(y))), (a, b)


def test_word_counts_rule_out_no_similar_pair():
    import numpy as np

    r = random.Random(12)
    for _ in range(500):
        a = [f"w{r.randrange(60)}" for _ in range(r.randint(5, 400))]
        b = edited(a, r.randint(1, len(a) // 4), r)
        x, y = ([w.encode() for w in t] for t in (a, b))
        bins = np.array([np.frombuffer(neardup.word_bins(neardup.word_hashes(t)), np.uint8) for t in (x, y)]).astype(np.int16)
        if neardup.similar(x, y):
            assert neardup.possible(np.array([0]), np.array([1]), np.array([len(x), len(y)]), bins, neardup.SIMILARITY)[0]


def test_short_and_spread_edits(spark):
    r, rows = random.Random(13), []
    for k in range(60):
        n = r.choice([5, 7, 9, 12, 20, 30, 31, 40, 80, 200])
        a = [f"k{k}w{i}" for i in range(n)]
        b = [f"x{k}y{i}" if i % 5 == (2 if n < 10 else 4) else w for i, w in enumerate(a)] if n != 9 else [*a[:4], "other", *a[5:]]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert classes(spark, rows) == plain_classes(rows)
