"""Crowded nodes: what is dealt of them grows as their texts do, and no pair is lost or made twice by blocks and rounds."""

from __future__ import annotations

import random

import numpy as np
from test_neardup_recall import classes, edited, plain_classes

from loomkit.llm import neardup


def test_rare_words_take_two_rows_and_few_bytes_a_text(spark):
    r = random.Random(31)
    base = [f"w{r.randrange(5000)}" for _ in range(3000)]
    rows = [(bytes([k]), " ".join(edited(base, 100, r))) for k in range(4)]
    found = neardup.by_rare_words(spark.createDataFrame(rows, "_node binary, _text string"), 0.8).collect()
    assert len(found) == 8 and {bytes(x["_node"]) for x in found} == {node for node, _ in rows}
    assert 0 < sum(len(x["_before"]) for x in found) < sum(len(text) for _, text in rows)  # 601 rows a text and 1.4 MB, once


def test_meeting_gives_all_pairs_with_a_number_in_common(monkeypatch):
    monkeypatch.setattr(neardup, "MADE_AT_ONCE", 7)
    r = random.Random(32)
    for n, most in ((1, 5), (2, 1), (12, 200), (30, 500), (30, 3)):
        lists = [np.array(sorted({r.randrange(most) for _ in range(r.randint(0, 4))}), np.uint32) for _ in range(n)]
        shared = {(a, b) for b in range(n) for a in range(b) if {*lists[a]} & {*lists[b]}}
        made = [(int(x), int(y)) for a, b in neardup.meeting(lists, n) for x, y in zip(a, b)]
        assert shared <= {*made} and all(a < b for a, b in made)
        assert {*made} == shared or len(made) == n * (n - 1) // 2  # all pairs only if they are no more
        whole = [(int(x), int(y)) for a, b in neardup.meeting(None, n) for x, y in zip(a, b)]
        assert sorted(whole) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_odd_bits_are_a_bound():
    r = np.random.default_rng(33)
    counts = np.minimum(r.poisson(0.2, (60, neardup.FINE_BINS)) * r.integers(1, 200, (60, 1)), 255).astype(np.uint8)
    odd = neardup.odd_bits(counts)
    assert odd.shape == (60, neardup.ODD // 64)
    for a in range(60):
        apart = np.abs(counts[a].astype(int) - counts).sum(1)
        assert (np.bitwise_count(odd[a] ^ odd).sum(1, dtype=int) <= apart).all()


def test_blocks_and_rounds_lose_no_pair_and_make_none_twice(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "CROWD_BLOCKS", 1)
    monkeypatch.setattr(neardup, "COPIES", 1)
    r = random.Random(34)
    base = [f"w{r.randrange(150)}" for _ in range(130)]
    texts = [edited(base[: r.randint(70, 130)], r.randint(0, 8), r) for _ in range(30)]  # of several levels of length
    nodes = spark.createDataFrame([(bytes([k]), bytes([k % 9]), " ".join(t)) for k, t in enumerate(texts)], "_node binary, _root binary, _text string")
    met = neardup.by_rare_words(nodes, 0.8).join(nodes.select("_node", "_root"), "_node").cache()
    parts = neardup.rounds(met)
    monkeypatch.setattr(type(met), "distinct", lambda df: df)
    made = [[(bytes(x["_hub"])[0], bytes(x["_node"])[0]) for x in neardup.rivals(met, 0.8, neardup.fine_counts(nodes), k, parts).collect()] for k in range(parts)]
    near = {(a, b) for b in range(30) for a in range(b) if a % 9 != b % 9 and neardup.similar(*([w.encode() for w in texts[k]] for k in (a, b)))}
    found = [x for part in made for x in part]
    assert parts > 3 and sum(map(bool, made)) > 1 and len(near) > 50
    assert len(found) == len({*found}) and near <= {*found} and all(a % 9 != b % 9 for a, b in found)


def test_classes_of_a_crowd_in_rounds(spark, monkeypatch):
    for name, n in (("CROWD", 4), ("BLOCK", 2), ("CROWD_BLOCKS", 2), ("COPIES", 1), ("MADE_AT_ONCE", 10)):
        monkeypatch.setattr(neardup, name, n)
    tags, plain = [], neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, tag: tags.append(tag) or plain(df, tag))
    r = random.Random(35)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage[: r.randint(45, 60)] + [f"c{k % 5}q{i % 20}" for i in range(r.randint(15, 30))] for k in range(36)]
    texts += [edited(texts[k], r.randint(8, 15), r) for k in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert classes(spark, rows) == plain_classes(rows)
    assert "rare" in tags and tags.count("rivals") > 1


def test_shared_keys_are_marked_and_their_rows_whole(spark, monkeypatch):
    """110 of some 39,000 keys are shared: no more bits are set, and other rows stay where they are."""
    rows = [(bytes([k // 256, k % 256]), k, [k * 7919 + i * 104729 << 20 | (k * 200 + i) for i in range(197)] + [-5 - k // 2, 1 << 62 | k % 9, 77]) for k in range(200)]
    nodes = spark.createDataFrame(rows, "_node binary, _n long, _keys array<long>").repartition(3)
    want = {}
    for node, n, keys in rows:
        for key in keys:
            want.setdefault(key, []).append((key, node, n))
    want = sorted(x for found in want.values() if len(found) > 1 for x in found)
    for bits in (neardup.BITS, 1 << 15):
        monkeypatch.setattr(neardup, "BITS", bits)
        got = neardup.shared(nodes)
        assert sorted((x["_key"], bytes(x["_node"]), x["_n"]) for x in got.collect()) == want
        marked = np.unpackbits(neardup.marked(got), bitorder="little")
        assert len(marked) == bits and {*np.flatnonzero(marked)} == {key % bits for key, _, _ in want}
    assert len(want) == 600
