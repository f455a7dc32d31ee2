"""Whole operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomkit.llm import binary, decontaminate, encode, licenses, neardup, packing, quality, repeats, secrets, tokens, toxicity

WORDS = random.Random(5).choices(["stone", "river", "cloud", "Amber", "seven", "lantern", "walks", "under", "bright", "meadow", "quiet", "zone"], k=400)
A = " ".join(f"{w}{i}" for i, w in enumerate(WORDS[:120]))
NEAR = A.replace("stone", "pebble", 3)
LONG = " ".join(WORDS * 40) + "\n  password = 'abcdefgh12345678'\n\ttail "
ROWS = [(1, A), (2, A), (2, A), (3, None), (4, ""), (None, "few words"), (5, LONG), (6, NEAR), (7, A.lower() + " under the mit license")]
CLASH = ["lang", "n_words", "n_tokens", "secrets", "hits", "licenses", "score", "kept", "_node", "_id", "_class", "_row", "task", "start"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *(f"own {c}" for c in CLASH)) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path).collect())
    assert got == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t in ROWS)
    assert tokens.count_tokens(none, path).count() == 0


def test_frequent_pre_tokens(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 3)
    monkeypatch.setattr(tokens, "HELD", 50)
    r = random.Random(25)
    texts = [(" ".join(r.choices(["often", "oft", "some", *(f"rare{i}" for i in range(300))], [300, 200, 100] + [1] * 300, k=200)),) for _ in range(40)] + [(None,), ("",), ("  ",), ("x" * 100,) * 1]
    assert tokens.frequent(spark.createDataFrame(texts, "text string").repartition(3)) == ["often", "oft", "some"]


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=64, open_windows=2).collect()
    of_doc, of_sequence = {}, {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append(p)
        of_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in dict(ROWS).items():
        own = lib.encode(text or "", add_special_tokens=False).ids + [1]
        times = sum(d == doc for d, _ in ROWS)
        assert sorted((p.start, p.length) for p in of_doc[doc])[0][0] == 0 and sum(p.length for p in of_doc[doc]) == times * len(own)
        assert all(bytes(p.ids) == encode.packed(own[p.start : p.start + p.length]) for p in of_doc[doc])
    for window in of_sequence.values():
        window.sort(key=lambda p: p.offset)
        assert [p.offset for p in window] == np.cumsum([0, *(p.length for p in window)])[:-1].tolist() and sum(p.length for p in window) <= 64
    assert packing.pack(none, path).count() == 0


def test_quality(docs, none, spark):
    weights = quality.train(docs, spark.createDataFrame([(1, 1), (7, 1), (None, 0)], "doc_id long, quality int"))
    got = {r.text: r for r in quality.judge(docs, weights).collect()}
    assert got[None].n_words == got[""].n_words == 0 and got[None].base_failed and not got[""].kept and got[A].kept
    assert quality.judge(none, weights).count() == 0 and quality.judge(docs, weights).count() == len(ROWS)


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (None, None), (5, 5), (6, 1), (7, 1)], key=str)
    kept = neardup.one_of_each(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, None, 5], key=str) and {r["_node"] for r in kept} == {"own _node"}
    assert neardup.near_duplicates(none).count() == neardup.one_of_each(none).count() == 0


def test_scans(docs, none, spark):
    found = secrets.find_secrets(docs).collect()
    assert len(found) == len(ROWS) and [r.doc_id for r in found if r.secrets] == [5] and next(r for r in found if r.text is None).secrets == []
    assert "abcdefgh" not in next(r for r in secrets.redact(docs).collect() if r.doc_id == 5).text
    bench = spark.createDataFrame([(9, " ".join(A.split()[10:25])), (9, " ".join(A.split()[10:25])), (8, None), (None, ""), (7, "few WORDS")], "item_id long, text string")
    hits = {(r.doc_id, r.n_words): r["items"] for r in decontaminate.find_passages(docs, bench).collect()}
    assert hits[1, 120] == [9] and hits[None, 2] == [7] and hits[3, 0] == hits[4, 0] == []
    assert decontaminate.digest(decontaminate.find_passages(docs, bench, block_bytes=20)).orderBy("doc_id", "n_words").collect() == decontaminate.digest(decontaminate.find_passages(docs, bench)).orderBy("doc_id", "n_words").collect()
    labels = {r.doc_id: r.labels for r in licenses.digest(licenses.find_licenses(docs)).collect()}
    assert labels[7] == "mit" and labels[1] == labels[3] == ""
    assert secrets.find_secrets(none).count() == licenses.find_licenses(none).count() == decontaminate.find_passages(none, bench).count() == 0


def test_toxicity(docs, none, spark):
    model = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and len({r.score for r in got}) == 1 and toxicity.score(none, model).count() == 0
    assert [r.held_out for r in toxicity.digest(toxicity.score(docs, model)).collect() if r.doc_id is None] == [False]


def test_toxicity_learns_from_its_folds_only(spark):
    """Labels of fold 0 play no part; the held-out documents are told apart; a repeated id counts once, whatever the order."""
    r = random.Random(26)
    text = lambda bad: " ".join(r.choices(["lorem", "ipsum", "dolor", "amet"], k=30) + (["you", "vileword"] if bad else ["you", "friend"]))
    rows = [(i, text(i % 4 == 0)) for i in range(600)] + [(7, "another text")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = [(i, int(i % 4 == 0)) for i in range(600)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth]  # wrong where they may not be looked at
    models = [toxicity.train(d, spark.createDataFrame(t, "doc_id long, toxic int")) for d, t in ((docs.repartition(2), truth), (docs.repartition(5), turned))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    got = toxicity.digest(toxicity.score(docs, models[0])).where("held_out").collect()
    assert len(got) > 80 and all(x.predicted == int(x.doc_id % 4 == 0) and (x.score >= 0.5) == bool(x.predicted) for x in got)


ODD = "doc_id long, text string, `a.b` string, N_Words string, Hits string, KEPT int, `we``ird` string, _hits0 string, _Items0 string, _row string"


def test_columns_of_any_name(spark):
    """Dots, quotes, other cases and the operators' own private names in extra columns."""
    rows = [(1, A, "x", "n", "h", 1, "w", "p", "q", "r"), (2, A.replace("a", "e"), "y", "n", "h", 1, "w", "p", "q", "r")]
    odd = spark.createDataFrame(rows, ODD)
    bench = spark.createDataFrame([(9, " ".join(A.split()[10:25]))], "item_id long, text string")
    for size in (1 << 20, 20):
        found = decontaminate.find_passages(odd, bench, block_bytes=size)
        assert set(found.columns) == {"doc_id", "text", "a.b", "KEPT", "we`ird", "_hits0", "_Items0", "_row", "n_words", "hits", "items"}
        first = found.where("doc_id = 1").head()
        assert first["a.b"] == "x" and first["_hits0"] == "p" and first["items"] == [9]
    judged = quality.judge(odd, quality.train(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert "N_Words" not in judged.columns and "KEPT" not in judged.columns and quality.digest(judged).count() == 2
    kept = neardup.one_of_each(odd)
    assert {r["a.b"] for r in kept.collect()} == {"x", "y"} and kept.columns == odd.columns
    assert secrets.redact(odd).columns == odd.columns and secrets.digest(secrets.find_secrets(odd)).count() == 2
    assert licenses.digest(licenses.find_licenses(odd)).count() == toxicity.digest(toxicity.score(odd, toxicity.train(odd, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")))).count() == 2
    assert tokens.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model")).count() == 2


def test_token_store(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in binary.stored(docs, path).collect()), key=lambda r: r[0])
    at, want = 0, []
    for doc, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((at, doc, len(ids), zlib.crc32(encode.packed(ids))))
        at += len(ids)
    assert got == want and binary.stored(none, path).count() == 0


@pytest.mark.parametrize("text", ["a\tb", "\tfoo", " x y", "x  y", "a\n\nb", "a \nb", "a\n b", "end ", "end\n", "no break", "a\u0085b", "x\x1cy", "a\r\nb", "　wide", "plain words\nof two lines"])
def test_white_space(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert encode.encoder(path).encode(text) == encode.packed(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def plain_removal(rows: list[tuple]) -> list[tuple]:
    n, firsts = repeats.LENGTH, {}
    datas = [(d, (t or "").encode()) for d, t in rows]
    for d, data in datas:
        if d is not None:
            for i in range(len(data) - n + 1):
                firsts[data[i : i + n]] = min(d, firsts.get(data[i : i + n], d))
    out = []
    for d, data in datas:
        gone = np.zeros(len(data), bool)
        if d is not None:
            for i in range(len(data) - n + 1):
                if firsts[data[i : i + n]] < d:
                    gone[i : i + n] = True
        out.append((d, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def test_repeats_of_a_crowd(spark, monkeypatch):
    """More contexts of a fingerprint than one shard takes, at each step of halving."""
    monkeypatch.setattr(repeats, "CROWD", 3)
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    middle, heads, tails = letters(40), [letters(30) for _ in range(6)], [letters(30) for _ in range(6)]
    rows = [(i, rnd.choice(heads)[rnd.choice([0, 0, 3, 20]) :] + middle + rnd.choice(tails)[: rnd.choice([30, 30, 8, 20])] + letters(5)) for i in range(80)]
    rows += [(i, letters(9) + "za" * 20 + letters(rnd.randint(0, 9)) + "za" * 40) for i in range(80, 100)] + [(i, letters(3) + middle + heads[0] + letters(3)) for i in range(100, 120)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain_removal(rows)


def test_repeats_in_long_texts(spark, monkeypatch):
    """Texts longer than what is read at once, and tasks that reduce their fingerprints more than once."""
    monkeypatch.setattr(repeats, "PIECE", 300)
    monkeypatch.setattr(repeats, "FLUSH", 40)
    rnd = random.Random(6)
    passages = ["".join(rnd.choices("abcdefgh é", k=rnd.randint(40, 400))) for _ in range(8)]
    rows = [(i, "".join(rnd.choice(passages) + "".join(rnd.choices("xyz ", k=rnd.randint(0, 9))) for _ in range(rnd.choice([0, 1, 2, 12])))) for i in range(40)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain_removal(rows)


def test_repeats_need_integer_ids(spark):
    with pytest.raises(TypeError, match="integer"):
        repeats.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("again", [False, True])
def test_repeats(spark, none, again):
    rnd = random.Random(3)
    passages = ["".join(rnd.choices("abcdefgh é", k=rnd.randint(40, 130))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(passages) + "".join(rnd.choices("xyz ", k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, passages[0] * 2), (62, "z" * 300), (63, "z" * 200), (64, rows[5][1])]
    if again:
        rows += [(5, passages[1] + "!"), rows[7], rows[7]]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain_removal(rows)
    assert repeats.remove_repeats(none).count() == 0
