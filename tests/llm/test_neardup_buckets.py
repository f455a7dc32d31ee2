"""Buckets whose least node is unlike members that are like each other, against brute force."""

from __future__ import annotations

import random

import numpy as np

from test_neardup_recall import classes, edited, plain_classes

from loomkit.llm import neardup


def test_families_on_one_passage(spark):
    r = random.Random(17)
    passage = [f"p{i}" for i in range(60)]
    centres = [passage + [f"c{k}q{i}" for i in range(25)] for k in range(25)]
    rows = [(i, " ".join(edited(r.choice(centres), r.randint(5, 9), r))) for i in range(150)]
    assert classes(spark, rows) == plain_classes(rows)


def test_crowded_buckets(spark, monkeypatch):
    """Unlike texts with one passage, and families among them: buckets are dealt anew by rare words, hubs split."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    monkeypatch.setattr(neardup, "STAR", 2)
    dealt, plain = [], neardup.by_rare_words
    monkeypatch.setattr(neardup, "by_rare_words", lambda *a: dealt.append(1) or plain(*a))
    r = random.Random(19)
    passage = [f"p{i}" for i in range(40)]
    texts = [passage + [f"c{k}q{i % 30}" for i in range(60)] for k in range(40)]
    texts += [edited(texts[k % 7], r.randint(10, 22), r) for k in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert classes(spark, rows) == plain_classes(rows) and dealt


def test_similar_texts_share_rare_words(spark):
    r, rows = random.Random(20), []
    for k in range(80):
        a = [f"w{r.randrange(80)}" for _ in range(r.randint(5, 120))]
        rows += [(bytes([k, 0]), " ".join(a)), (bytes([k, 1]), " ".join(edited(a, r.randint(1, max(1, len(a) // 5)), r)))]
    keys = {}
    for x in neardup.by_rare_words(spark.createDataFrame(rows, "_node binary, _text string").repartition(3), 0.8).collect():
        keys.setdefault(bytes(x["_node"]), set()).add(x["_key"])
    near = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if neardup.similar(neardup.words(s), neardup.words(t))]
    assert len(near) > 40 and all(keys[a] & keys[b] for a, b in near)


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r = random.Random(18)
    members = [(7, bytes([i]), bytes([i % 5]), 10, bytes(neardup.BINS)) for i in range(20)] + [(8, bytes([i]), bytes([1]), 10, bytes(neardup.BINS)) for i in range(4)]
    r.shuffle(members)
    met = spark.createDataFrame(members, "_key long, _node binary, _root binary, _n long, _bins binary")
    got = sorted((bytes(p["_hub"])[0], bytes(p["_node"])[0]) for p in neardup.rivals(met, 0.8).collect())
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20) if a % 5 != b % 5]


def test_nodes_without_chances_are_not_dealt(spark):
    """Of unlike texts with one passage none is dealt by its words; of similar texts of different classes all are."""
    r = random.Random(21)
    passage = [f"p{i}" for i in range(20)]
    unlike = [passage + [f"c{k}q{i}" for i in range(60)] for k in range(50)]
    family = [edited(passage + [f"c0x{i}" for i in range(r.randint(40, 160))], 0, r) for _ in range(6)]
    near = [edited(t, len(t) // 5, r) for t in family]
    copies = [unlike[0][:-1] + [f"z{k}"] for k in range(5)]  # like unlike[0], and of its class
    texts = [*unlike, *family, *near, *copies]
    root = lambda k: 0 if k >= len(texts) - len(copies) else k
    rows = [(bytes([k]), bytes([root(k)]) * 16, " ".join(t)) for k, t in enumerate(texts)]
    kept = neardup.with_chances(spark.createDataFrame(rows, "_node binary, _root binary, _text string").repartition(3), 0.8)
    got = {bytes(x["_node"])[0] for x in kept.select("_node").collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if root(a) != root(b) and neardup.similar(*([w.encode() for w in texts[k]] for k in (a, b)))]
    assert len(pairs) >= 6 and got >= {k for pair in pairs for k in pair}
    assert not got & {*range(len(unlike)), *range(len(texts) - len(copies), len(texts))}


def test_least_edits_is_a_bound():
    r, tight = random.Random(22), 0
    for _ in range(300):
        a = [b"w%d" % r.randrange(30) for _ in range(r.randint(1, 40))]
        b = [w.encode() for w in edited([w.decode() for w in a], r.randint(0, 9), r)]
        there = [np.array([tuple(a[i : i + k]) in {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} for i in range(len(a) - k + 1)], bool) for k in neardup.RUNS]
        least = neardup.least_edits(there)
        assert neardup.within(a, b, 40) and (least == 0 or not neardup.within(a, b, least - 1))
        tight += least > 0
    assert tight > 100


def test_counts_use_lengths():
    """20 edits at most, 16 of them for the lengths: 4 words may differ, not 6."""
    a = [b"w%d" % i for i in range(100)]
    for other, expected in ((4, True), (6, False)):
        b = a[: 84 - other] + [b"x%d" % i for i in range(other)]
        bins = np.array([np.frombuffer(neardup.word_bins(neardup.word_hashes(t), 1 << 14), np.uint8) for t in (a, b)])
        got = neardup.possible(np.array([0]), np.array([1]), np.array([len(a), len(b)]), bins, 0.8)[0]
        assert got == neardup.similar(a, b) == expected


def test_crowds_make_few_pairs(spark, monkeypatch):
    """Texts with three quarters in common, and rare words of many kinds: fine counts rule pairs out before texts are fetched."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    made, plain = [], neardup.rivals
    monkeypatch.setattr(neardup, "rivals", lambda *a: made.append(plain(*a)) or made[-1])
    monkeypatch.setattr(neardup, "forget", lambda *a: None)
    r = random.Random(23)
    passage = [f"p{i}" for i in range(600)]
    texts = [passage + [f"v{r.randrange(4000)}" for _ in range(200)] for _ in range(36)]
    texts += [edited(texts[k], 60, r) for k in range(4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert classes(spark, rows) == plain_classes(rows)
    pairs = [{(x["_hub"], x["_node"]) for x in m.collect()} for m in made]
    assert len(made) == 2 and len(set().union(*pairs)) < 80  # 763 by BINS counts and without the lengths


def test_fine_counts_lose_no_pair(spark):
    r = random.Random(24)
    texts = [[f"w{r.randrange(300)}" for _ in range(r.randint(50, 300))] for _ in range(8)]
    texts += [edited(t, len(t) // 6, r) for t in texts for _ in range(3)]
    named = spark.createDataFrame([(bytes([k]), " ".join(t)) for k, t in enumerate(texts)], "_node binary, _text string")
    met = named.selectExpr("1L _key", "_node", "_node _root")
    got = {(bytes(x["_hub"])[0], bytes(x["_node"])[0]) for x in neardup.rivals(met, 0.8, neardup.fine_counts(named)).collect()}
    near = {(a, b) for b in range(len(texts)) for a in range(b) if neardup.similar(*([w.encode() for w in texts[k]] for k in (a, b)))}
    assert len(near) > 20 and got >= near


def test_pairs_are_made_once(spark, monkeypatch):
    """Nodes that share many rare words are one pair of one bucket, blocks or not."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    r = random.Random(25)
    base = [f"w{i}" for i in range(100)]
    rows = [(bytes([k]), " ".join(edited(base, 6, r))) for k in range(12)]
    texts = spark.createDataFrame(rows, "_node binary, _text string")
    met = neardup.by_rare_words(texts, 0.8).selectExpr("_key", "_node", "_node _root", "_before")
    monkeypatch.setattr(type(met), "distinct", lambda df: df)
    got = sorted((bytes(x["_hub"])[0], bytes(x["_node"])[0]) for x in neardup.rivals(met, 0.8, neardup.fine_counts(texts)).collect())
    assert got == [(a, b) for a in range(12) for b in range(a + 1, 12)]
